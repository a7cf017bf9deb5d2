"""Main text of web pages by wrapper induction.

For every host the blocks of all its different pages are counted (copies of a page by their text
count once). A block with the same text at the same place on all of them is template, the others
are slots; the parts of the tree that hold the article's slots become the host's regions: all
article and main elements, else the deepest node outside which no page has slots. A wrapper (region
paths and hashes of template blocks) is a few hundred bytes. Applying it to all pages is one parse
per page: blocks of the regions and of the page's own article and main elements, without template
blocks and without what by its element, role, class or id is a menu, advert, notice, form or
comment list. A page that doesn't fit its host's wrapper, or has no host, takes its own article,
main or body as the region.
"""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import drop, ship, written
from wordmill.llm.components import join_by_weight
from wordmill.llm.html_tree import Node, parse

MOST_NODES = 1500      # nodes of a large page
LEAST_PAGES = 4        # different pages that must agree before a block is template
ODD_PAGES = 13         # one page in so many may lack a template block: none of up to 12
ODD_SLOTS = 100        # one page in so many may have slots outside the region
MAIN = ("article", "main")
BLOCK, SOFT, PLACE = 0, 1, 2      # what is counted: blocks, soft marks, article and main elements


def _nodes(root: Node):
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(reversed(n.children))


def _hash(path: str, text: str) -> str:
    from xxhash import xxh64_hexdigest
    return xxh64_hexdigest(f"{path}\n{text}")


def _own_regions(root: Node) -> list[Node]:
    """Outermost article or main elements that can hold the article; else body; else all."""
    found = []
    todo = [root]
    while todo:
        n = todo.pop()
        if n.off:
            continue
        if n.tag in MAIN:
            found.append(n)
        else:
            todo.extend(reversed(n.children))
    if found:
        return found
    return [n for n in _nodes(root) if n.tag == "body"][:1] or [root]


def _body(root: Node) -> tuple:
    """The texts in a page's own regions: equal for copies of a page."""
    return tuple(x.text() for r in _own_regions(root) for x in _nodes(r))


def _regions(root: Node, paths: list[str]) -> list[Node]:
    """Outermost nodes of the wrapper's paths and the page's own article and main elements, in
    page order."""
    found = []
    todo = [(root, False)]
    while todo:
        n, off = todo.pop()
        off = off or n.off
        if n.path in paths or (n.tag in MAIN and not off):
            found.append(n)
        else:
            todo.extend((c, off) for c in reversed(n.children))
    return found


def _long(digest: str) -> int:
    """A path or hash as a signed long; the root's path is 0."""
    v = int(digest, 16) if len(digest) == 16 else 0
    return v - (1 << 64) if v >> 63 else v


def _digest(v: int) -> str:
    return f"{v & ((1 << 64) - 1):016x}" if v else "#"


def _facts(html: str | None) -> tuple:
    """What the counts of a host need of a page: hash of the text in its own regions, whether it
    has no article or main (None for an empty page, which isn't counted), the different ``(kind, key)`` on it, and, without article or main, its
    region's tree as rows ``up, path, key, size`` (parent's index, path, hash and size of the own
    text), parents first."""
    from xxhash import xxh64_intdigest
    if not html:
        return 0, None, [], []
    root = parse(html)
    own = _own_regions(root)
    plain = own[0].tag not in MAIN
    found, keys = set(), {}
    for n in _nodes(root):
        text = n.text()
        if text:
            keys[id(n)] = _long(_hash(n.path, text)), len(text)
            found.add((BLOCK, keys[id(n)][0]))
        if n.soft:
            found.add((SOFT, _long(n.path)))
    tree: list = []
    if plain:
        todo = [(own[0], -1)]
        while todo:
            n, up = todo.pop()
            if not n.off:
                tree.append((up, _long(n.path), *keys.get(id(n), (0, 0))))
                todo.extend((c, len(tree) - 1) for c in reversed(n.children))
    else:
        found.update((PLACE, _long(n.path)) for n in own)
    body = "\n".join(_body(root)).encode("utf-8", "surrogatepass")
    return xxh64_intdigest(body) - (1 << 63), plain, sorted(found), tree


def _slots(tree: list, template) -> list[tuple]:
    """``path, parent path, top, whole, one, kids`` of the paths in a page's tree: whether it is the
    tree's root, whether its nodes hold all slots of the page, whether a single one does, and
    whether it has children. Nothing where the page has no slots."""
    sums = [0 if key in template else size for _, _, key, size in tree]
    kids = [False] * len(tree)
    for i in range(len(tree) - 1, 0, -1):      # children before their parents
        sums[tree[i][0]] += sums[i]
        kids[tree[i][0]] = True
    if not tree or not sums[0]:
        return []
    found: dict = {}
    for (up, path, _, _), n, k in zip(tree, sums, kids):
        f = found.setdefault(path, [tree[up][1] if up >= 0 else None, 0, False, False])
        f[1] += n
        f[2] = f[2] or n == sums[0]
        f[3] = f[3] or k
    return [(path, up, up is None, n == sums[0], one, k) for path, (up, n, one, k) in found.items()]


def _common(counts, n: int, n_plain: int) -> dict:
    """A wrapper without the regions of plain pages, from ``(kind, key, pages)`` of ``n`` pages."""
    if n < 2:
        return {"region": None, "template": []}
    odd = n // ODD_PAGES
    of: dict = {BLOCK: [], SOFT: [], PLACE: []}
    for kind, key, c in counts:
        if kind == BLOCK:
            ok = n >= LEAST_PAGES and c >= max(LEAST_PAGES, n - odd)
        elif kind == SOFT:      # what a word in its class marks goes if it comes back on other pages
            ok = c >= max(2, n / 3)
        else:
            ok = c > odd
        if ok:
            of[kind].append(_digest(key))
    return {"region": [] if 2 * n_plain > n else sorted(of[PLACE]), "template": sorted(of[BLOCK]),
            "soft": sorted(of[SOFT])}


def _deepest(rows, n_plain: int) -> list[str]:
    """Region paths of plain pages: from the root of their trees down to the deepest node outside
    which no page that has its path has slots. ``rows``: sums of ``_slots`` over the pages, ``path,
    up, top, has, whole, one, kids``."""
    below: dict = {}
    for r in rows:
        below.setdefault(r["up"], []).append(r)
    found = []
    for top in [r for r in rows if r["top"] and r["has"] > n_plain // ODD_PAGES]:
        at = top
        while True:
            down = [r for r in below.get(at["path"], ()) if not r["top"] and 2 * r["one"] > top["has"]
                    and 2 * r["kids"] > r["has"] and r["has"] - r["whole"] <= r["has"] // ODD_SLOTS]
            if not down:
                break
            at = max(down, key=lambda r: (r["one"], r["path"]))
        found.append(_digest(at["path"]))
    return sorted(found)


def induce(pages: list[str]) -> dict:
    """Wrapper of one host's pages: ``region`` (paths or None), ``template`` hashes, ``soft``
    paths. What ``wrappers`` finds for tables, for a list."""
    facts: dict = {}
    for f in map(_facts, filter(None, pages)):
        facts.setdefault(f[0], f)      # copies of a page say nothing about slots
    n, n_plain = len(facts), sum(f[1] for f in facts.values())
    counts = Counter(x for f in facts.values() for x in f[2])
    found = _common([(*x, c) for x, c in counts.items()], n, n_plain)
    if 2 * n_plain > n > 1:
        template = {_long(x) for x in found["template"]}
        sums: dict = {}
        for f in facts.values():
            for path, up, *flags in _slots(f[3], template):
                old = sums.setdefault(path, [up, 0, 0, 0, 0, 0])
                sums[path] = [up, *(a + b for a, b in zip(old[1:], (flags[0], 1, *flags[1:])))]
        found["region"] = _deepest([dict(zip(("path", "up", "top", "has", "whole", "one", "kids"),
                                             (path, *x))) for path, x in sums.items()], n_plain)
    return found


INSIDE = frozenset("a span b i em strong small label time".split())


def _blocks(top: Node, template: frozenset, soft: frozenset, out: list[str]) -> None:
    """Append the blocks below a node in page order."""
    todo: list = [top]
    run: list[str] = []
    while todo:
        c = todo.pop()
        if type(c) is str:
            run.append(c)
            continue
        if type(c) is Node and c.off and c.tag in INSIDE and c is not top:
            continue            # left out inside its block, which goes on
        out.append(" ".join("".join(run).split()))
        run = []
        if c is None or c.off or (c.soft and c.path in soft) or (
                template and c.text() and not c.children and _hash(c.path, c.text()) in template):
            continue
        todo.append(None)       # ends the block
        todo.extend(reversed(c.content))


def extract(html: str | None, wrapper: dict | None = None) -> str:
    """The main text: blocks in page order joined by a blank, white space inside a block one
    blank; null and empty pages give an empty text."""
    if not html:
        return ""
    root = parse(html)
    regions = []
    template: frozenset = frozenset()
    soft = frozenset((wrapper or {}).get("soft", ()))
    if wrapper and wrapper["region"] is not None:
        regions = _regions(root, wrapper["region"])
        template = frozenset(wrapper["template"]) if regions else template
    out: list[str] = []
    for n in regions or _own_regions(root):
        _blocks(n, template, soft, out)
    return " ".join(b for b in out if b)


def host(url) -> "F.Column":
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1),
                              F.lit("")))


LONGS = pa.list_(pa.int64())
FACTS = ("host string, h long, body long, plain boolean, kinds array<long>, keys array<long>, "
         "up array<long>, path array<long>, own array<long>, size array<long>")


def _read(batches):
    """The facts of every page (``FACTS``), from ``host, h, html``."""
    for b in batches:
        facts = [_facts(html.as_py()) for html in b.column(2)]
        lists = ([[x[k] for x in f[2]] for f in facts] for k in range(2))
        trees = ([[x[k] for x in f[3]] for f in facts] for k in range(4))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([f[0] for f in facts], pa.int64()),
             pa.array([f[1] for f in facts], pa.bool_()), *(pa.array(x, LONGS) for x in (*lists, *trees))],
            names=[c.split()[0] for c in FACTS.split(", ")])


def _outside(batches):
    """``_slots`` of plain pages, from ``host, up, path, own, size, template``."""
    for b in batches:
        out: Counter = Counter()
        for host, *tree, template in zip(*(b.column(i).to_pylist() for i in range(6))):
            for path, up, *flags in _slots(list(zip(*tree)), frozenset(template or ())):
                out[host, path, up, *flags] += 1
        rows = [(h, path, up, c, *(c * f for f in flags)) for (h, path, up, *flags), c in out.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(8)],
            names=["host", "path", "up", "has", "top", "whole", "one", "kids"])


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON), ``w`` (pages of the host), from ``page_id, host, html``. Every page
    is counted, copies by their text once; a host's counts meet in sums made before the shuffle, and
    only what stands on one page in ``ODD_PAGES`` comes together for it."""
    ship(pages.sparkSession)
    keyed = (pages.where("host <> ''").select("host", F.xxhash64("page_id", "host", "html").alias("h"),
                                              "html"))
    texts, at = written(
        keyed.mapInArrow(_read, FACTS).groupBy("host", "body").agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by(F.struct("plain", "kinds", "keys", "up", "path", "own", "size"), "h").alias("f"))
        .select("host", "n", "f.*"), "host-texts")
    hosts, at_hosts = written(texts.groupBy("host").agg(
        F.sum("n").alias("w"), F.count("plain").alias("n"),
        F.count_if("plain").alias("n_plain")), "host-sizes")
    total = max(1, hosts.agg(F.sum("n_plain")).head()[0] or 0)
    counts = (texts.select("host", F.explode(F.arrays_zip("kinds", "keys")).alias("x"))
              .groupBy("host", F.col("x.kinds").alias("kind"), F.col("x.keys").alias("key"))
              .agg(F.count(F.lit(1)).alias("c"))
              .where(F.col("c") >= F.when(F.col("kind") == BLOCK, LEAST_PAGES)
                     .when(F.col("kind") == SOFT, 2).otherwise(1))
              .join(hosts.select("host", "n"), "host").where(F.col("c") * ODD_PAGES > F.col("n"))
              .groupBy("host").agg(F.collect_list(F.struct("kind", "key", "c")).alias("counts")))

    def common(batches):
        for pdf in batches:
            found = [_common([(x["kind"], x["key"], x["c"]) for x in (counts if counts is not None else ())],
                             n, p) for counts, n, p in zip(pdf["counts"], pdf["n"], pdf["n_plain"])]
            yield pd.DataFrame({
                "host": pdf["host"], "w": pdf["w"], "n_plain": pdf["n_plain"],
                "wrapper": [json.dumps(x) for x in found],
                "plain": (2 * pdf["n_plain"] > pdf["n"]) & (pdf["n"] > 1),
                "template": [[_long(t) for t in x["template"]] for x in found]})
    made, at_made = written(hosts.join(counts, "host", "left").mapInPandas(
        common, "host string, w long, n_plain long, wrapper string, plain boolean, template array<long>"),
        "host-templates")
    trees = join_by_weight(texts.where("plain").select("host", "up", "path", "own", "size"),
                           made.where("plain").select("host", "template", "n_plain"), "host", "n_plain", total)
    sums = (trees.select("host", "up", "path", "own", "size", "template").mapInArrow(
        _outside, "host string, path long, up long, has long, top long, whole long, one long, kids long")
        .groupBy("host", "path").agg(F.min("up").alias("up"), *[
            F.sum(c).alias(c) for c in ("has", "top", "whole", "one", "kids")])
        .join(made.select("host", "n_plain"), "host").where(F.col("has") * ODD_PAGES > F.col("n_plain"))
        .groupBy("host").agg(F.collect_list(F.struct(
            "path", "up", "top", "has", "whole", "one", "kids")).alias("paths")))

    def regions(batches):
        for pdf in batches:
            out = []
            for raw, plain, n_plain, paths in zip(pdf["wrapper"], pdf["plain"], pdf["n_plain"], pdf["paths"]):
                if plain:
                    raw = json.dumps(json.loads(raw) | {
                        "region": _deepest([dict(r) for r in paths] if paths is not None else [], n_plain)})
                out.append(raw)
            yield pd.DataFrame({"host": pdf["host"], "wrapper": out, "w": pdf["w"]})
    found = written(made.join(sums, "host", "left").select("host", "w", "n_plain", "wrapper", "plain", "paths")
                    .mapInPandas(regions, "host string, wrapper string, w long"), "wrappers")[0]
    for path in (at, at_hosts, at_made):
        drop(pages.sparkSession, path)
    return found


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` (code points), one row per input row. Null html counts as
    empty; null or malformed urls have no host; repeated rows are all returned; other columns
    are not read. An empty table gives an empty result."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"),
                        pages["html"].alias("html"), host(pages["url"]).alias("host"))
    made = wrappers(rows)
    total = max(1, made.agg(F.sum("w")).head()[0] or 0)
    fitted = (join_by_weight(rows, made, "host", "w", total)
              .unionByName(rows.where("host = ''").withColumns(
                  {"wrapper": F.lit(None).cast("string"), "w": F.lit(0).cast("long")})))

    def run(batches):
        known: dict[str, dict] = {}
        for b in batches:
            out = []
            for html, raw in zip(b.column(2), b.column(3).to_pylist()):
                if raw and raw not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[raw] = json.loads(raw)
                out.append(extract(html.as_py(), known.get(raw) if raw else None))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out, pa.string()),
                 pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return fitted.select("page_id", "url", "html", "wrapper").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
