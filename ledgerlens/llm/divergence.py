"""Source divergence audit: how far the word use of each source lies from every other source of its language.

Identical texts of a language are collapsed first: one text with the number of times each source holds it. A text is
tokenised once; its term counts are weighted by those numbers. Pairs of sources are then summed over the terms that at
least one of both holds (see ``pairs``), never over the whole vocabulary.

Terms are runs of letters A-Z (lower-cased) and characters from U+0080 on. A null text, lang or source counts as ''.
Every row of the input is a document, also rows that repeat an id or a text. Other columns are ignored. A document
without terms (empty, digits only) still makes its (lang, source) group occur. A lang without kept terms has pairs with
value 0 and no terms; a source alone in its lang has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import rows
from ledgerlens.session import stage

LEAST_DOCUMENTS = 3  # documents of a lang that must hold a term for it to be kept
TERM_RANKS = 200
SCALE = 1_000_000_000
SOURCES = 256  # sources of a text that travel with one copy of it
HELD = 500_000  # (lang, source, term) entries a task sums up before it hands them on
HIGH = 64  # occurrences stand above this bit of an entry, documents below it: one look-up adds both
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their sources to (lang, source, term, occurrences, documents), summed up within the task."""
    held: dict[tuple[str, str], dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
    size, low = 0, (1 << HIGH) - 1

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), entries in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(entries), pa.string()), pa.array([source] * len(entries), pa.string()), pa.array(entries, pa.binary()).cast(pa.string()),
                 pa.array([e >> HIGH for e in entries.values()], pa.int64()), pa.array([e & low for e in entries.values()], pa.int64())],
                ["lang", "source", "term", "uses", "docs"])
        held.clear()

    for part in rows(batches):
        for lang, text, copies in zip(*part):
            terms = Counter(text.translate(LETTERS).split()).items()
            for copy in copies:
                entries, n = held[lang, copy["source"]], copy["n"]
                size -= len(entries)
                for term, k in terms:
                    entries[term] += (k * n << HIGH) + n
                size += len(entries)
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def group_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lang, source) of every document, (lang, source, term, uses, docs) of every term that a group holds).

    Copies are counted by digest, which moves no text; each different text of a lang moves once, because a task keeps
    one of the copies it reads. A text that very many sources hold goes with 256 of them at a time.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("body"))
    copies = stage(keyed.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")), "divergence-copies")
    place = F.row_number().over(Window.partitionBy("lang", "digest").orderBy("source"))
    held_by = copies.withColumn("part", F.floor((place - 1) / SOURCES)).groupBy("lang", "digest", "part").agg(
        F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = keyed.groupBy("lang", "digest").agg(F.any_value("body").alias("body"))
    counted = texts.join(held_by, ["lang", "digest"]).select("lang", "body", "copies").mapInArrow(
        _counted, "lang string, source string, term string, uses long, docs long")
    cells = counted.groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
    return copies.select("lang", "source").distinct(), cells


def _share(uses: str, total: str, v: str = "v") -> Column:
    """1 + floor(SCALE * (uses + 1) / (total + v)) in exact arithmetic."""
    return F.expr(f"1 + ({SCALE} * cast({uses} + 1 as decimal(20,0))) div ({total} + {v})")


def _f(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of two columns of whole numbers."""
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(q))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` and ``term`` of every group, see the module's docstring.

    ``pair``: how far the source lies from each other source of its lang. ``term``: the 200 terms that mark it most
    against its lang as a whole.
    """
    occurring, cells = group_terms(docs)
    cells = stage(cells, "divergence-cells")
    of_term = Window.partitionBy("lang", "term")
    kept = cells.withColumns({
        "df": F.sum("docs").over(of_term), "lang_uses": F.sum("uses").over(of_term),
        "first": (F.row_number().over(of_term.orderBy("source")) == 1).cast("long")})
    kept = stage(kept.where(F.col("df") >= LEAST_DOCUMENTS).select("lang", "source", "term", "uses", "lang_uses", "first"), "divergence-kept")

    sums = kept.groupBy("lang", "source").agg(F.sum("uses").alias("total"), F.sum("first").alias("v"))
    of_lang = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("v").alias("v"))
    groups = occurring.join(sums.drop("v"), ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    groups = stage(groups.withColumn("z", F.when(F.col("v") > 0, _share("0", "total"))), "divergence-groups")  # z: share of an absent term
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "z", _share("uses", "total").alias("p"), _share("lang_uses", "lang_total").alias("q"))
    shares = stage(shares, "divergence-shares")

    marks = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = marks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TERM_RANKS)
    return pairs(groups, shares).withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Sum of f(p, q) over all kept terms for every ordered pair of sources of a lang.

    With p and q for a term both hold and zs, zt for a term the source or the other lacks, the sum is
    v f(zs, zt)                                          as if nobody held anything
    + sum over the source's terms of f(p, zt) - f(zs, zt)
    + sum over the other's terms  of f(zs, q) - f(zs, zt)
    + sum over shared terms       of f(p, q) - f(p, zt) - f(zs, q) + f(zs, zt).
    The second and third depend on a share alone, so equal shares are counted first; only the last needs terms.
    """
    me = groups.select("lang", "source", "v", F.col("z").alias("zs"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("zt"))
    base = me.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * _f("zs", "zt"), F.lit(0)).alias("value"))
    levels = shares.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("m"))
    mine = levels.withColumnRenamed("z", "zs").join(other, "lang").where("source <> item").select(
        "lang", "source", "item", (F.col("m") * (_f("p", "zt") - _f("zs", "zt"))).alias("value"))
    theirs = levels.withColumnsRenamed({"z": "zt", "source": "item", "p": "q"}).join(me, "lang").where("source <> item").select(
        "lang", "source", "item", (F.col("m") * (_f("zs", "q") - _f("zs", "zt"))).alias("value"))
    a = shares.select("lang", "term", "source", F.col("z").alias("zs"), "p")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("z").alias("zt"), F.col("p").alias("q"))
    shared = a.join(b, ["lang", "term"]).where("source <> item").select(
        "lang", "source", "item", (_f("p", "q") - _f("p", "zt") - _f("zs", "q") + _f("zs", "zt")).alias("value"))
    parts = base.unionByName(mine).unionByName(theirs).unionByName(shared)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
