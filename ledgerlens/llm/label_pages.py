"""Labelled pages to train the main-text model on: invented pages whose ``data-main`` attribute tells main text (1) from the rest (0).

A page is a frame of surroundings with a body in it. The label of an element holds for what lies in it until another one
is given; the top has label 0. Prose is drawn from a few words by a fixed seed, so that only its shape can be learned.
"""

from __future__ import annotations

import random

WORDS = (
    "harbour lantern copper meadow violin granite orchard ferry candle ledger thimble walnut saddle compass basket pebble "
    "quarry anchor bramble kettle Fenster Brücke Garten während schnell château rivière lumière toujours ventana camino "
    "montaña río and the of with under over after before").split()


class Prose:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, n: int) -> str:
        return " ".join(self.random.choice(WORDS) for _ in range(n))

    def line(self, n: int | None = None) -> str:
        return self.words(n or self.random.randint(4, 14)).capitalize() + self.random.choice([".", ".", ".", "?", "!"])

    def text(self, sentences: int | None = None) -> str:
        return " ".join(self.line() for _ in range(sentences or self.random.randint(2, 7)))

    def links(self, n: int = 5, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{i}'>{self.words(self.random.randint(1, 3))}</a></{tag}>" for i in range(n))


def bodies(p: Prose) -> list[str]:
    """What stands inside the element that holds the main text."""
    ad = f"<div class='ad' data-main=0>{p.text(2)}</div>"
    long = "".join(f"<p>{p.text()}</p>" for _ in range(6))
    return [
        f"<h1>{p.words(6)}</h1>" + long,
        f"<h1>{p.words(9)}</h1><p><b>{p.line()}<br><p>{p.text()}<p>{p.line(3)}<p>{p.text()}</p>",
        f"<h2>{p.words(4)}</h2><p>{p.text()}</p><ul><li>{p.line()}</li><li>{p.words(4)}</li><li>{p.text(2)}</li></ul><p>{p.line(2)}</p>",
        f"<p>{p.text()}</p><blockquote><p>{p.text()}</p></blockquote><p>{p.text(1)} <a href='/x'>{p.words(3)}</a> {p.line()}</p>" + ad + f"<p>{p.text()}</p>",
        f"<h1>{p.words(5)}</h1><p>{p.line(2)}</p><p>{p.text()}</p><table><tr><th>{p.words(1)}</th><th>{p.words(2)}</th></tr><tr><td>{p.words(2)}</td><td>{p.words(1)}</td></tr></table>",
        f"<p>{p.text()}</p><figure><img src=x><figcaption>{p.line()}</figcaption></figure><h3>{p.words(3)}</h3><pre>{p.words(12)}</pre><p>{p.text()}</p>",
        f"<section><h2>{p.words(4)}</h2><p>{p.text()}</p></section><section><h2>{p.words(3)}</h2><div>{p.text()}</div><div>{p.line(3)}</div></section>",
        f"<h1>{p.words(4)}</h1><p>{p.line(1)}</p>",
        f"<h1>{p.words(10)}</h1><p><b>{p.words(14)}<br>",
        f"<h1>{p.words(10)}</h1><p><b>{p.words(80)}<br>",
        f"<p>{p.words(2)}</p>",
        f"<h1>{p.line(7)}</h1><p>{p.line(5)} {p.words(6)}</p>",
        f"<h1>{p.words(7)}</h1><p class='lead'>{p.text(2)}</p><aside class='related' data-main=0><h4>{p.words(2)}</h4><ul>{p.links(3)}</ul></aside>{long}"
        f"<form class='newsletter' data-main=0><label>{p.line()}</label><input><button>{p.words(1)}</button></form>",
        f"{p.text()}<br><br>{p.text()}<div class='advert' data-main=0><a href='/buy'>{p.line()}</a></div>{p.text()}",
        f"<p><span class='drop'>{p.words(1)}</span> {p.text()}</p><p>{p.line(4)}</p><p>{p.text()}</p><div class='share' data-main=0>{p.links(3, 'span')}</div>",
    ]


def holders(body: str) -> list[str]:
    """The elements that may hold it."""
    return [
        f"<article data-main=1>{body}</article>",
        f"<main data-main=1>{body}</main>",
        f"<div class='post-content' data-main=1>{body}</div>",
        f"<div id='x17' data-main=1>{body}</div>",
        f"<div id='story' data-main=1><div>{body}</div></div>",
        f"<section data-main=1><article>{body}</article></section>",
        f"<main data-main=1><article class='entry'>{body}</article></main>",
        f"<table><tr><td data-main=1>{body}</td></tr></table>",
        f"<div data-main=1>{body}</div>",
    ]


def frames(main: str, p: Prose) -> list[str]:
    """Whole pages around it: menus, headers, footers, sidebars, notices, adverts, forms and readers' comments."""
    head = f"<!DOCTYPE html><html><head><title>{p.words(5)}</title><style>p{{margin:0}}</style><script>var a='<p>';</script></head>"
    remarks = "".join(f"<div class='comment'><b>{p.words(1)}</b><p>{p.text()}</p></div>" for _ in range(3))
    cookie = f"<div class='cookie-notice'><p>{p.text(2)}</p><button>{p.words(1)}</button></div>"
    side = f"<aside><h3>{p.words(2)}</h3><p>{p.text(2)}</p><ul>{p.links(4)}</ul></aside>"
    rights = f"<footer>&copy; {p.words(2)} &middot; {p.text(1)}</footer>"
    return [
        f"{head}<body><nav><ul>{p.links(6)}</ul></nav><!-- x --><div class='ad'>{p.text(2)}</div>{main}{rights}</body></html>",
        f"{head}<body><header><h1>{p.words(2)}</h1><p>{p.line()}</p></header>{main}<section id='comments'><h2>{p.words(2)}</h2>{remarks}</section>{rights}",
        f"{head}<body>{cookie}<div id='menu'>{p.links(5, 'div')}</div><div id='page'>{main}{side}</div><div id='footer'><p>{p.line()}</p><p>{p.links(3, 'span')}</p></div></body>",
        f"{head}<body><div class='banner'><a href='/'>{p.words(4)}</a></div><div class='wrapper'><div class='sidebar'><p>{p.text(3)}</p>{p.links(4, 'p')}</div>{main}</div>"
        f"<div class='footer-links'><ul>{p.links(6)}</ul><p>&copy; {p.words(3)}. All rights reserved.</p></div></body>",
        f"{head}<body><div role='navigation'>{p.links(4, 'span')}</div>{main}<div class='sponsored'><p>{p.text(2)}</p></div><form action='/s'><p>{p.line()}</p><input name=q></form>{rights}</body>",
        f"{head}<body><table class='nav'><tr><td>{p.links(4, 'span')}</td></tr></table>{main}<ol class='commentlist'><li><p>{p.text(2)}</p></li><li><p>{p.text(4)}</p></li></ol><p>&copy; {p.words(3)}</p></body>",
        f"{head}<body><div class='modal' style='display:none'><p>{p.text(2)}</p></div><header class='top'><nav>{p.links(5, 'span')}</nav></header>{main}"
        f"<div class='related-posts'><h3>{p.words(2)}</h3><ul>{p.links(5)}</ul></div><div id='replies'><div><p>{p.text(3)}</p></div><div><p>{p.text(2)}</p></div></div>{rights}</body>",
        f"{head}<body><p class='notice'>{p.text(1)}</p><ul>{p.links(7)}</ul>{main}<div class='promo'>{p.text(2)}</div><div class='widget'><h4>{p.words(2)}</h4><p>{p.text(2)}</p></div><div>{p.links(5, 'span')}</div>",
    ]


def labelled_pages(seed: int = 11) -> list[str]:
    """Every body in every frame, with the holders taken in turn."""
    out = []
    n_bodies, n_frames = len(bodies(Prose(0))), len(frames("", Prose(0)))
    for b in range(n_bodies):
        for f in range(n_frames):
            p = Prose(seed + 1000 * b + f)
            held = holders(bodies(p)[b])
            out.append(frames(held[(b * n_frames + f) % len(held)], p)[f])
    return out
