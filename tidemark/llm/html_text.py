"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts. Neighbouring equal groups are folded into a repeated group, and streams of the same host
are aligned one after another: what both have stays, what differs in text becomes a text slot, and what one lacks becomes
an optional group. A text that no page of the host lacks or words differently is the template's; what is left of each
page, and the names around it, then decide which element holds its article.
"""

from __future__ import annotations

import bisect
import collections
import functools
import hashlib
import html
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

#: Names of elements (fixed values of the markup language).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded mphantom menclose semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements and names that hold no part of an article (fixed values).
FURNITURE = frozenset("head nav footer aside form button select option script style noscript template iframe title dialog menu object canvas svg textarea annotation annotation-xml".split())
FURNITURE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related recommended replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
#: Of these, elements that hold no text of a page at all.
UNSEEN = frozenset("head button select option script style noscript template iframe title object canvas svg textarea annotation annotation-xml".split())
#: First parts of names that say what a layout has around its article, and last parts that keep the sense of a first one.
LAYOUT = frozenset("has have is no not with without hide hidden show".split())
PLACES = frozenset("area bar block bottom box container content inner items left link links list main nav outer panel primary right secondary section text top wrap wrapper".split())
FURNITURE_ROLES = frozenset("banner navigation contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Elements that are nested deeper don't open levels of their own, as in browsers; their texts count where they stand.
DEPTH = 512
#: Runs that neither unique nodes nor ends cut are aligned by all their pairs up to so many, beyond that by the next equal node.
ALL_PAIRS = 1_000_000
#: So many pages of a host tell its template.
LEAST_PAGES = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def tokens(page: str):
    """Yields (kind, name, names) for tags (kind 1 begins an element, -1 ends one) and (0, text, ()) for texts."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield 0, page[at:], ()
            return
        if m.start() > at:
            yield 0, page[at : m.start()], ()
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield -1, name, ()
            continue
        marks = []
        for a in _NAME.finditer(m[3]):
            value = a[2] or a[3] or a[4] or ""
            marks.append((a[1].lower(), value))
        yield 1, name, tuple(marks)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            yield -1, name, ()


def _label(name: str, marks: tuple) -> str:
    """An element as a wrapper knows it: digits in names don't tell elements apart."""
    extra = "".join(f" {k}={re.sub(r'[0-9]+', '0', v)}" for k, v in sorted(marks))
    return name + extra


def _named(token: str) -> bool:
    """Whether a class or id names furniture: by all of it or its last part, or by its first part and a place."""
    parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if x]
    if not parts or parts[0] in LAYOUT:
        return False
    return parts[-1] in FURNITURE_NAMES or (parts[0] in FURNITURE_NAMES and all(x in PLACES for x in parts[1:]))


@functools.lru_cache(10_000)
def _furniture(label: str, inside: bool) -> int:
    """Whether an element holds no part of an article: by what it is (3), what it is for (2) or a mere name (1); a header within an article may."""
    name, *marks = label.split(" ")
    if name in UNSEEN:
        return 3
    if name in FURNITURE or (name == "header" and not inside):
        return 1 if name == "form" else 2
    named = False
    key = ""
    for m in marks:
        if "=" in m:
            key, _, m = m.partition("=")
        if key == "role" and m.lower() in FURNITURE_ROLES:
            return 2
        named |= key != "role" and _named(m)
    return int(named and name not in ("html", "body", "article", "main"))


def walk(page: str):
    """Yields (path, text, breaks) for each text, and (path, None, True) where a block begins or ends.

    path: the labels of the open elements. Elements that are never closed end with the ones around them.
    """
    stack: list[str] = []
    for kind, name, marks in tokens(page):
        if kind == 0:
            yield stack, name
            continue
        if kind == 1:
            if name in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    open_name = stack[k].split(" ")[0]
                    if open_name == "p":
                        del stack[k:]
                        break
                    if open_name not in INLINE:
                        break
            if name == "li" and stack and stack[-1].split(" ")[0] == "li":
                stack.pop()
        if name == "br":
            yield stack, " "
            continue
        if name not in INLINE:
            yield stack, None
        if name in VOID:
            continue
        if kind == 1:
            if len(stack) < DEPTH:
                stack.append(_label(name, marks))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].split(" ")[0] == name:
                    del stack[k:]
                    break


# --- wrappers: lists of nodes. A node is ["t", path] (text slot), ["+", nodes] (repeated) or ["?", nodes] (optional); the first
# two end with the value or the values of their texts as long as these are fixed, the same on all pages ----------------------


def _value(text: str) -> str:
    """12 digits of a text's hash and its length."""
    text = " ".join(text.split())
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest() + str(len(text))


def stream(page: str) -> list:
    """A page's texts in order: the path around a text that isn't blank, and its value."""
    out, known = [], {}
    for path, text in walk(page):
        if text is not None and not text.isspace():
            p = "/".join(path)
            out.append(["t", known.setdefault(p, p), _value(text)])
    return out


def shape(nodes: list) -> list:
    """The nodes with all texts as slots."""
    return [n[:2] if n[0] == "t" else [n[0], shape(n[1])] for n in nodes]


def merge(a: list, b: list) -> list:
    """Nodes of one shape: texts that differ become slots."""
    return [x if x == y else ["?", merge(x[1], y[1])] if x[0] == "?" else x[:2] for x, y in zip(a, b, strict=True)]


def _values(nodes: list) -> list[str] | None:
    """The values of all texts, if all are fixed."""
    if any(n[0] == "?" or len(n) == 2 for n in nodes):
        return None
    return [v for n in nodes for v in ([n[2]] if n[0] == "t" else n[2])]


def _repeats(codes: np.ndarray, size: int) -> np.ndarray:
    """For each place, how many nodes from it on equal the ones size places further, without a break."""
    same = codes[:-size] == codes[size:]
    stop = np.where(same, len(same), np.arange(len(same)))
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(len(same))


def fold(nodes: list) -> list:
    """Folds neighbouring groups of equal shape, short ones first, into repeated groups.

    A group's length is the distance of two equal nodes, so that only such lengths are tried.
    """
    size, number = 0, {}
    while True:
        shapes = shape(nodes)
        codes = np.array([number.setdefault(json.dumps(x), len(number)) for x in shapes], np.int64)
        order = np.argsort(codes, kind="stable")
        gaps = np.diff(order)[np.diff(codes[order]) == 0]
        sizes = [int(x) for x in np.unique(gaps) if size < x <= len(nodes) // 2]
        out = None
        for size in sizes:
            run = _repeats(codes, size)
            if run.max() < size:
                continue
            out, k = [], 0
            while k < len(nodes):
                times = 1 + int(run[k]) // size if k < len(run) else 1
                if times > 1 and not (size == 1 and shapes[k][0] == "+"):
                    group = shapes[k : k + size]
                    values = _values(nodes[k : k + times * size])
                    out.append(["+", group] if values is None else ["+", group, values])
                    k += times * size
                else:
                    out.append(nodes[k])
                    k += 1
            if len(out) < len(nodes):
                break
            out = None
        if out is None:
            return nodes
        nodes, size = out, 0 if size > 1 else 1


def _core(node: list) -> str:
    """What nodes must share to be aligned: paths, with a repeated or optional single text as the text."""
    while node[0] in "+?" and len(node[1]) == 1:
        node = node[1][0]
    return json.dumps(shape([node])[0][1])


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common run of a and b, rising in both: equal ends first, then what is unique in both, then all that lies between."""
    out, left = [], [(0, len(a), 0, len(b))]
    while left:
        i, m, j, n = left.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once = [collections.Counter(a[i:m]), collections.Counter(b[j:n])]
        place = {x: k for k, x in enumerate(b[j:n], j) if once[0][x] == once[1][x] == 1}
        pairs = _rising([(k, place[x]) for k, x in enumerate(a[i:m], i) if x in place])
        if pairs:
            out += pairs
            ends = [(i - 1, j - 1), *pairs, (m, n)]
            left += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:], strict=False)]
        elif (m - i) * (n - j) <= ALL_PAIRS:
            out += [(i + p, j + q) for p, q in _longest(a[i:m], b[j:n])]
        else:
            where: dict[str, list[int]] = {}
            for k in range(j, n):
                where.setdefault(b[k], []).append(k)
            last = j - 1
            for k in range(i, m):
                at = where.get(a[k], [])
                q = bisect.bisect_right(at, last)
                if q < len(at):
                    last = at[q]
                    out.append((k, last))
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of pairs (rising in the first) that rises in the second too."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, q) in enumerate(pairs):
        p = bisect.bisect_left(tails, q)
        tails[p : p + 1] = [q]
        at[p : p + 1] = [k]
        before.append(at[p - 1] if p else -1)
    k, out = at[-1] if at else -1, []
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common run, by all pairs."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list:
    """The wrapper of two: a common run of nodes stays, the rest becomes optional; a node that one has repeated is repeated."""
    if a == b or not b:
        return a if a == b else [n if n[0] == "?" else ["?", [n]] for n in a]
    out, i, j = [], 0, 0
    for p, q in [*_matches([_core(n) for n in a], [_core(n) for n in b]), (len(a), len(b))]:
        out += [n if n[0] == "?" else ["?", [n]] for n in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(_joined(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold(out)


def _joined(x: list, y: list) -> list:
    if x == y:
        return x
    optional = "?" in (x[0], y[0])
    x, y = (n[1][0] if n[0] == "?" and len(n[1]) == 1 else n for n in (x, y))
    if shape([x]) == shape([y]):
        node = merge([x], [y])[0]
    else:
        node = shape([x if x[0] == "+" or y[0] != "+" else y])[0]
    return ["?", [node]] if optional else node


def fixed(wrapper: list) -> list[str]:
    """The values of the texts that all pages have alike: those of slots, optional groups and differing repeats aren't."""
    return sorted({v for n in wrapper for v in _values([n]) or ()})


def _holds(label: str) -> bool:
    """Whether an element may hold an article, and not just a paragraph of it."""
    return label.split(" ")[0] not in INLINE and not re.match(r"(p|h[1-6]|li|td|blockquote|pre)\b", label)


def decide(size: dict[str, int], same: dict[str, int]) -> set[str]:
    """The paths of a page whose texts are the article. size, same: characters at each path, of all texts and of the template's.

    Furniture goes. Of the rest, texts within an article or main element stay; without one, those within the smallest
    element with three quarters of the rest's characters, the template's not counted. In either, elements of template texts only
    go; a paragraph or heading that stands among others stays.
    """
    marks: dict[str, list[tuple[int, int]]] = {}
    first, last = {}, {}
    for p in size:
        labels, found = p.split("/"), []
        first[p] = last[p] = 0
        for k, x in enumerate(labels, 1):
            kind = _furniture(x, first[p] > 0)
            if kind:
                found.append((k, kind))
            if x.split(" ")[0] in ("article", "main") or " role=main" in x:
                first[p], last[p] = first[p] or k, k
        if all(kind < 3 for _, kind in found):
            marks[p] = found
    if not any(first[p] and not found for p, found in marks.items()):
        # a name doesn't make furniture of an element that holds most of the page
        under: dict[str, int] = {}
        for p, found in marks.items():
            for k, kind in found:
                if kind == 1:
                    head = "/".join(p.split("/")[:k])
                    under[head] = under.get(head, 0) + size[p]
        total = sum(size[p] for p in marks)
        most = {head for head, n in under.items() if 4 * n >= 3 * total}
        marks = {p: [(k, kind) for k, kind in found if "/".join(p.split("/")[:k]) not in most] for p, found in marks.items()}
    free = {p: first[p] for p, found in marks.items() if not found}
    if not any(free.values()):
        # an article clears what is around it, unless there is more text beside it
        cleared = {p: last[p] for p, found in marks.items() if found and found[-1][0] < last[p]}
        if sum(size[p] for p in cleared) > sum(size[p] for p in free):
            free |= cleared
    own = {p: size[p] - same.get(p, 0) for p in free}
    if not any(own.values()):
        own = {p: size[p] for p in free}
    heads: dict[str, int] = {}
    for p in free:
        labels = p.split("/")
        for k in range(1, len(labels) + 1):
            if _holds(labels[k - 1]):
                head = "/".join(labels[:k])
                heads[head] = heads.get(head, 0) + own[p]
    if any(free.values()):
        kept = {p: inside for p, inside in free.items() if inside}
        if not any(own[p] for p in kept):
            return set(kept)
    else:
        total, best = sum(own.values()), ""
        for head, n in heads.items():
            if 4 * n >= 3 * total and len(head) > len(best):
                best = head
        kept = {p: best.count("/") + 1 if best else 0 for p in free if not best or p == best or p.startswith(best + "/")}
    out = set()
    for p, depth in kept.items():
        labels = p.split("/")
        if all(heads.get("/".join(labels[: k + 1]), 1) for k in range(depth, len(labels))):
            out.add(p)
    return out


def extract(page: str, template: frozenset[str] = frozenset()) -> str:
    """The blocks of a page at the paths that its texts decide, joined by two line feeds. template: values of the host's fixed texts."""
    parts, size, same, known = [], {}, {}, {}
    for path, text in walk(page):
        p = "/".join(path)
        p = known.setdefault(p, p)
        parts.append((p, text))
        if text is not None and not text.isspace():
            size[p] = size.get(p, 0) + len(text)
            if template and _value(text) in template:
                same[p] = same.get(p, 0) + len(text)
    keep = decide(size, same)
    blocks, begun = [], []
    for p, text in parts:
        if text is None:
            if begun:
                blocks.append("".join(begun))
                begun = []
        elif p in keep:
            begun.append(html.unescape(text))
        elif text == " " and begun:
            begun.append(text)
    blocks.append("".join(begun))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#\s@]*@)?([^/?#\s]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, nodes (JSON: the wrapper) and template (values of its fixed texts) of each host, from all pages (url, html) with text.

    Pages whose folded streams have equal shapes count as one when streams are aligned; streams of a host are first aligned in
    64 shares. Fewer than LEAST_PAGES pages, or pages that are for the most part alike, copies of one another, tell no template.
    """

    def folded(batches):
        for batch in batches:
            known: dict[tuple[str, str], list] = {}
            for where, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts = stream(page or "")
                if not texts:
                    continue
                nodes = fold(texts)
                held = known.setdefault((where, json.dumps(shape(nodes))), [nodes, 0, 0])
                held[0] = merge(held[0], nodes)
                held[1] += 1
                held[2] += sum(int(t[2][12:]) for t in texts)
            rows = [(h, _value(s), json.dumps(nodes), n, c) for (h, s), (nodes, n, c) in known.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k > 2 else pa.string()) for k in range(5)], ["host", "shape", "nodes", "n", "chars"])

    parts = pages.select(_host().alias("host"), "html").mapInArrow(folded, "host string, shape string, nodes string, n long, chars long")
    streams = common.written(parts).withColumn("share", F.pmod(F.xxhash64("shape"), F.lit(64)).cast("int"))

    def aligned(pdf):
        import pandas as pd

        known: dict[str, list] = {}
        for s in pdf["nodes"]:  # a row for each shape of a host's share, not for each page
            nodes = json.loads(s)
            key = json.dumps(shape(nodes))
            known[key] = merge(known[key], nodes) if key in known else nodes
        whole: list = []
        for k, s in enumerate(sorted(known, key=lambda s: (-len(s), s))):
            nodes = known[s]
            whole = align(whole, nodes) if k else nodes
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "nodes": [json.dumps(whole)], "n": [pdf["n"].sum()], "chars": [pdf["chars"].sum()]})

    some = streams.groupBy("host", "share").applyInPandas(aligned, "host string, nodes string, n long, chars long")
    one = some.groupBy("host").applyInPandas(aligned, "host string, nodes string, n long, chars long")

    def told(batches):
        for batch in batches:
            out = []
            for s, n, chars in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                values = fixed(json.loads(s))
                out.append(values if n >= LEAST_PAGES and 2 * n * sum(int(v[12:]) for v in values) <= chars else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["host", "nodes", "template"])

    return common.written(one.mapInArrow(told, "host string, nodes string, template array<string>"))


def main_text(pages: DataFrame, most_broadcast: int = 8 << 20) -> DataFrame:
    """pages (page_id, url, html, and others) with text, the article of each page, and n_chars; columns of these names are replaced.

    A null or empty html, or a page of furniture only, has an empty text. Pages without a host in their url are one host's.
    Repeated rows stay. An empty table gives an empty one.
    """
    rest = pages.drop("text", "n_chars", "template", "host")
    names = rest.columns
    made = wrappers(rest).where(F.size("template") > 0).select("host", "template")
    size = made.agg(F.sum(20 * F.size("template") + 100)).first()[0] or 0
    both = rest.withColumn("host", _host()).join(F.broadcast(made) if size <= most_broadcast else made, "host", "left").drop("host")

    def run(batches):
        common.release()
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in (*names, "template")}
            out = [extract(page or "", frozenset(t or ())) for page, t in zip(column["html"].to_pylist(), column["template"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in names), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*names, "text", "n_chars"])

    return both.mapInArrow(run, rest.withColumn("text", F.lit("").cast("string")).withColumn("n_chars", F.lit(0).cast("long")).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
