"""Language identification by interpolated Kneser-Ney character models.

For each language an n-gram model over letters (lower case; all else is one mark) is counted over every text to learn
from: tasks count, Spark sums, and discounted counts, continuation counts and contexts are group-bys. A model is
stored as sorted arrays of n-gram hashes, one pair of arrays for an order; hashes fall into ``2 ** SLOT_BITS`` slots,
so a model has a proven size whatever the corpus. A text's score under a language is its cross-entropy per n-gram.
The language of the lowest one is chosen. How far it lies below the next one, and above what is usual for the
language, is calibrated on a bounded sample, by models that are counted without it; a text beyond the usual is marked
as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import held_out, mixed, rows
from ledgerlens.session import stage

ORDER = 4  # letters of an n-gram
SLOT_BITS = 18  # an order of a language's model has at most 2 ** 18 entries
CALIBRATED = 2000  # documents of a language that the calibration uses, about and at most
SAMPLED = 0.25  # the share of a language's documents that the calibration uses, at most
AT_ONCE = 1 << 21  # letters that a task counts or scores at once
DISCOUNT = 0.75
SPREAD = 4.0  # bits that a text of one letter may lie above the usual; falls with the root of the length


def letter_codes() -> np.ndarray:
    """A code of 16 bits for each character of the basic plane: lower-case letters their own, others 1."""
    codes = np.ones(1 << 16, np.uint16)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            codes[c] = ord(low[0]) if ord(low[0]) > 1 else 1
    return codes


class Letters:
    """Texts as n-grams: a mark before and after every run of letters, one mark for whatever stands between."""

    def __init__(self):
        self.codes = letter_codes()

    def of(self, text: str | None) -> np.ndarray:
        """Codes of the text, runs of other characters reduced to one mark (1); empty if it has no letter."""
        if not text:
            return np.zeros(0, np.uint16)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = points < (1 << 16)
        if low.all():
            codes = self.codes[points]
        else:  # beyond the basic plane: letters fall into the private use area by their code
            codes = np.where(low, self.codes[np.where(low, points, 0)], 1).astype(np.uint16)
            for k in np.flatnonzero(~low):
                if chr(points[k]).isalpha():
                    codes[k] = 0xE000 + int(points[k]) % 0x1900
        codes = np.concatenate(([1], codes, [1])).astype(np.uint16)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
        codes = codes[keep]
        return codes if len(codes) > 1 else codes[:0]


def grams(codes: np.ndarray) -> np.ndarray:
    """The ORDER-grams, each as its codes in 64 bits, last letter lowest; the text begins with ORDER - 1 marks."""
    padded = np.concatenate((np.ones(ORDER - 2, np.uint64), codes.astype(np.uint64)))
    out = np.zeros(len(padded) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | padded[k : k + len(out)]
    return out


def slots(gram, order: int):
    """The slot of an n-gram's last ``order`` letters in the hash arrays."""
    low = gram & np.uint64((1 << 16 * order) - 1) if order < 4 else gram
    return (mixed(low ^ np.uint64(order * 0x51ED2701)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def count_grams(learn: DataFrame) -> DataFrame:
    """(lang, gram, n, rest) over all texts of ``learn`` (text, lang, sampled); ``rest``: outside the sampled ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        held: dict[tuple[str, bool], list[np.ndarray]] = {}
        size: dict[tuple[str, bool], int] = {}

        def out(key: tuple[str, bool]) -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(held.pop(key)), return_counts=True)
            size.pop(key)
            n = n.astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n), pa.array(0 * n if key[1] else n)],
                names=["lang", "gram", "n", "rest"],
            )

        for texts, *keys in rows(batches):
            for text, key in zip(texts, zip(*keys)):
                codes = letters.of(text)
                if len(codes):
                    own = grams(codes)
                    held.setdefault(key, []).append(own)
                    size[key] = size.get(key, 0) + len(own)
                    if size[key] >= AT_ONCE:
                        yield out(key)
        for key in list(held):
            yield out(key)

    counted = learn.select("text", "lang", "sampled").mapInArrow(run, "lang string, gram long, n long, rest long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"))


class Memo:
    """What has been computed for n-grams lately, in a table of fixed size; a clash costs time only."""

    BITS = 19

    def __init__(self, width: int):
        self.width = width

    def __getstate__(self) -> dict:
        return {"width": self.width}

    def of(self, gram: np.ndarray, compute) -> np.ndarray:
        if not hasattr(self, "keys"):
            self.keys, self.values = np.zeros(1 << self.BITS, np.uint64), np.zeros((1 << self.BITS, self.width))
        at = (mixed(gram) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.values[at]
        missed = np.flatnonzero(self.keys[at] != gram)
        if len(missed):
            new, back = np.unique(gram[missed], return_inverse=True)
            values = compute(new)
            out[missed] = values[back]
            at = (mixed(new) >> np.uint64(64 - self.BITS)).astype(np.int64)
            at, one = np.unique(at, return_index=True)
            self.keys[at], self.values[at] = new[one], values[one]
        return out


class Model:
    """Per language and order: sorted slots of n-grams with their mass, and of contexts with total and kinds."""

    def __init__(self, langs: list[str], grams_: dict, contexts: dict, letters: dict):
        self.langs, self.grams, self.contexts, self.letters = langs, grams_, contexts, letters
        self.scale, self.usual, self.memo = 1.0, {}, Memo(len(langs))

    @staticmethod
    def find(keys: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The values of the slots ``at``; zero where a slot is not among the sorted ``keys``."""
        if not len(keys):
            return np.zeros((len(at), *values.shape[1:]))
        k = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        hit = keys[k] == at
        return np.where(hit if values.ndim == 1 else hit[:, None], values[k], 0)

    def log2(self, lang: str, gram: np.ndarray) -> np.ndarray:
        """log2 of the probability of each n-gram's last letter after the others."""
        p = np.full(len(gram), 1.0 / (self.letters[lang] + 1))
        for order in range(1, ORDER + 1):
            keys, mass = self.grams[lang, order]
            over, kinds = self.contexts[lang, order]
            total, types = self.find(over, kinds, slots(gram >> np.uint64(16), order - 1) if order > 1 else np.zeros(len(gram), np.int64)).T
            c = self.find(keys, mass, slots(gram, order))
            seen = total > 0
            total = np.maximum(total, 1)
            p = np.where(seen, np.maximum(c - DISCOUNT, 0) / total + np.minimum(DISCOUNT * types / total, 1) * p, p)
        return np.log2(np.maximum(p, 1e-12))

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy per n-gram of each text's codes (rows) under each language (columns); infinite without text."""
        out = np.full((len(texts), len(self.langs)), np.inf)
        some = [k for k, t in enumerate(texts) if len(t)]
        if not some or not self.langs:
            return out
        own = [grams(texts[k]) for k in some]
        sizes = np.array([len(g) for g in own])
        logs = self.memo.of(np.concatenate(own), lambda g: np.stack([self.log2(lang, g) for lang in self.langs], axis=1))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        out[some] = -np.add.reduceat(logs, starts, axis=0) / sizes[:, None]
        return out

    def decide(self, entropies: np.ndarray, lengths: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text.

        The score is the chosen language's share of exp(-scale * sqrt(length) * entropy), the scale calibrated.
        """
        if not self.langs:
            return [None] * len(entropies), np.zeros(len(entropies)), np.ones(len(entropies), bool)
        best = entropies.argmin(axis=1)
        low = entropies[np.arange(len(best)), best]
        some = np.isfinite(low)
        gap = np.where(some[:, None], entropies - np.where(some, low, 0)[:, None], np.inf)
        score = np.where(some, 1 / np.maximum(np.exp(-self.scale * np.sqrt(np.maximum(lengths, 1))[:, None] * gap).sum(axis=1), 1), 0.0)
        limit = np.array([self.usual.get(self.langs[b], np.inf) for b in best])
        spread = SPREAD / np.sqrt(np.maximum(lengths, 1))
        return [self.langs[b] if s else None for b, s in zip(best, some)], score, ~some | (low > limit + spread)


def fit_counts(top: DataFrame) -> Model:
    """The models of all languages of ``top`` (lang, gram, n)."""
    low = lambda order: F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1))
    grams_: dict = {}
    contexts: dict = {}
    letters: dict = {}
    langs = sorted(r.lang for r in top.select("lang").distinct().collect())
    for order in range(ORDER, 0, -1):
        if order == ORDER:
            own = top.select("lang", "gram", "n")
        else:  # continuation: how many different letters stand before the n-gram
            longer = top.select("lang", low(order + 1).alias("longer")).distinct() if order + 1 < ORDER else top.select("lang", F.col("gram").alias("longer"))
            own = longer.select("lang", F.col("longer").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        own = stage(own, f"language-order-{order}")
        slot = f"slot{order}"

        def cut(pdf_iter, order=order):
            for batch in pdf_iter:
                gram = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                context = slots(gram >> np.uint64(16), order - 1) if order > 1 else np.zeros(len(gram), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(slots(gram, order)), pa.array(context), batch.column(2)], names=["lang", slot, "context", "n"]
                )

        placed = own.mapInArrow(cut, f"lang string, {slot} long, context long, n long")
        for r, store in (
            (placed.groupBy("lang", F.col(slot).alias("at")).agg(F.sum("n").cast("double").alias("mass"), F.lit(0.0).alias("kinds")), grams_),
            (placed.groupBy("lang", F.col("context").alias("at")).agg(F.sum("n").cast("double").alias("mass"), F.count("*").cast("double").alias("kinds")), contexts),
        ):
            got = r.toPandas()  # at most 2 ** SLOT_BITS rows for a language
            for lang in langs:
                part = got[got["lang"] == lang].sort_values("at")
                keys = part["at"].to_numpy(np.int32)
                values = part["mass"].to_numpy(np.float32) if store is grams_ else part[["mass", "kinds"]].to_numpy(np.float32)
                store[lang, order] = (keys, values)
        if order == 1:
            letters = {lang: len(grams_[lang, 1][0]) for lang in langs}
    return Model(langs, grams_, contexts, letters)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_best, score, rejected, bits, letters) for every row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = held.value, Letters()
        for ids, texts in rows(batches):
            codes = [letters.of(t) for t in texts]
            entropies, start = np.zeros((len(codes), len(model.langs))), 0
            while start < len(codes):  # few texts at once if they are long
                stop, size = start, 0
                while stop < len(codes) and (stop == start or size + len(codes[stop]) <= AT_ONCE):
                    size += len(codes[stop])
                    stop += 1
                entropies[start:stop] = model.entropies(codes[start:stop])
                start = stop
            sizes = np.array([len(c) for c in codes])
            best, score, rejected = model.decide(entropies, sizes)
            bits = entropies.min(axis=1) if model.langs else np.full(len(codes), np.inf)
            bits = [float(b) if np.isfinite(b) else None for b in bits]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rejected.astype(bool)), pa.array(bits, pa.float64()), pa.array(sizes, pa.int64())],
                names=["doc_id", "lang_best", "score", "rejected", "bits", "letters"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, lang_best string, score double, rejected boolean, bits double, letters long"
    )


def calibrate(model: Model, sample: DataFrame) -> None:
    """Sets the scale of scores (least log loss) and each language's usual cross-entropy, from ``sample`` (text, lang)."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = held.value, Letters()
        for texts, langs in rows(batches):
            codes = [letters.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array([len(c) for c in codes], pa.int64()), pa.array(list(model.entropies(codes)), pa.list_(pa.float64()))],
                names=["lang", "letters", "entropies"],
            )

    got = sample.select("text", "lang").mapInArrow(run, "lang string, letters long, entropies array<double>").where("letters > 0").toPandas()
    got = got[got["lang"].isin(model.langs)]
    if not len(got):
        return
    h, size = np.stack(got["entropies"].to_numpy()), got["letters"].to_numpy()
    true = got["lang"].map(model.langs.index).to_numpy()
    gap = (h - h.min(axis=1, keepdims=True)) * np.sqrt(size)[:, None]
    losses = {}
    for scale in 2.0 ** np.arange(-6, 4):
        z = -scale * gap
        losses[float(scale)] = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), true]).mean())
    model.scale = min(losses, key=lambda s: (losses[s], s))
    for j, lang in enumerate(model.langs):
        own = (h - SPREAD / np.sqrt(size)[:, None])[true == j, j]
        if len(own):
            model.usual[lang] = float(np.quantile(own, 0.999)) + 0.5


def identify(docs: DataFrame, calibrated: int = CALIBRATED) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, bits, letters) for every row of ``docs`` (doc_id, text, lang).

    Learns from the text and the non-null lang of documents that are not held out; a prediction looks at the text only.
    ``lang_pred`` is the language of the lowest cross-entropy, ``und`` with score 0 if the text is null or has no
    letter, or nothing could be learned. ``rejected`` marks texts whose cross-entropy is beyond what is usual for the
    language; the prediction stays. ``calibrated`` is about how many documents of a language, chosen by a hash, the
    calibration uses at most (and at most a quarter of them); the models that predict count these too. Repeated rows are
    scored alike, rows without doc_id are never learned from, other columns are ignored, an empty table gives an empty
    result.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    learn = own.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = learn.groupBy("lang").count().collect()
    dealt, sampled = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20), F.lit(False)
    if sizes:
        share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(calibrated / r["count"], SAMPLED))])
        sampled = F.coalesce(dealt < F.element_at(share, F.col("lang")), sampled)
    marked = learn.withColumn("sampled", sampled)
    top = stage(count_grams(marked), "language-grams")
    model = fit_counts(top.select("lang", "gram", "n"))
    if sizes:
        part = fit_counts(top.where("rest > 0").select("lang", "gram", F.col("rest").alias("n")))
        calibrate(part, marked.where("sampled"))
        model.scale, model.usual = part.scale, part.usual
    return scored(own, model).select(
        "doc_id", held_out().alias("held_out"), F.coalesce("lang_best", F.lit("und")).alias("lang_pred"), "score", "rejected", "bits", "letters"
    )
