"""Main text of web pages by site style trees.

All pages of a host are merged into one tree. Its element nodes are the ways down a page, label by label (an element with
its class, id and role, long numbers aside); its presentation nodes are the sequences of children that an element shows on some page.
A node matters as far as the site varies it:

- *presentation*: the entropy of its sequences of children over the pages that hold it, relative to evenly spread ones;
- *content*: one minus the mean entropy, over pages, of the texts below it. Boilerplate is spread evenly over all pages, content is not.

With ``l`` sequences the composite importance is ``(1 - GAMMA^l) presentation + GAMMA^l content``, less by the share of text
inside links where the page doesn't name its main part. Few pages tell little: on the way down from the root, which matters fully, a node
on ``m`` pages takes ``(k * its parent's + m * composite) / (k + m)``, where ``k`` is small for anonymous branches and large below a named
main part. Text in nodes below ``THRESHOLD`` is noise on all pages of the host. Exact copies of a page count once, and a node is judged by
its different texts, so that copies, near copies and passages that many pages quote don't turn an article into boilerplate.

A label that names its part (navigation, advert, comments, ...) weighs zero, and so does all that lies outside a part that the page
itself names as main. Entropies decide about everything else.

Trees are sums of counts per (host, node), combined before each shuffle, so a host may hold any share of all pages; no task
sees a site or a tree as a whole. Pages are read twice, for the counts and for the text.

Defined results: white space is what Unicode calls so, no-break spaces included; a null or empty page has an empty text;
pages with a null or unreadable url form one host; every row gives one row, repeated ones too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrain.llm.common import written
from hiregrain.llm.markup import Page, read_page

GAMMA = 0.9
THRESHOLD = 0.2
FEW, NAMED = 4.0, 20.0  # pseudo-counts: pages it takes to doubt a branch, anonymous or below a named main part
STYLE, TEXT, NODE = 0, 1, 2
SLICE = 256
NUMBER = re.compile(r"\d+")
COUNTS = "site string, page string, kind byte, node long, value long, n long, linked long, named boolean, path array<long>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _feature(text: str) -> int:
    """A block's text without case, and with all numbers alike: dates and counters don't make boilerplate differ."""
    return xxhash.xxh64_intdigest(NUMBER.sub("0", text.lower()).encode("utf-8", "replace"))


def page_counts(page: Page) -> Iterator[tuple]:
    """What a page adds to its site's tree: ``kind``, ``node``, ``value``, ``n``, ``linked``, ``named``, ``path``."""
    stay, named = page.kept()
    keys, paths = page.nodes(stay)
    children: list[list[str]] = [[] for _ in keys]
    for i, parent in enumerate(page.parents):
        if stay[i] and parent >= 0 and stay[parent]:
            children[parent].append(page.labels[i])
    styles = Counter((keys[i], xxhash.xxh64_intdigest("\n".join(c).encode())) for i, c in enumerate(children) if stay[i])
    texts: Counter = Counter()
    chars: Counter = Counter()
    linked: Counter = Counter()
    for branch, text, links in page.blocks:
        if stay[branch]:
            texts[keys[branch], _feature(text)] += 1
            chars[keys[branch]] += len(text)
            linked[keys[branch]] += links
    for kind, counts in ((STYLE, styles), (TEXT, texts)):
        for (node, value), n in counts.items():
            yield kind, node, value, n, 0, named, None
    for node, path in paths.items():
        yield NODE, node, 0, chars[node], linked[node], named, path


def _counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of :data:`COUNTS` for batches of ``site``, ``page`` and ``html``."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            of: list[int] = []
            columns: list[list] = [[] for _ in range(7)]
            for number, html in enumerate(part.column("html").to_pylist()):
                for row in page_counts(read_page(html or "")):
                    of.append(number)
                    for column, value in zip(columns, row):
                        column.append(value)
            kind, node, value, n, linked, named, path = columns
            at = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("site").take(at), part.column("page").take(at), pa.array(kind, pa.int8()),
                    pa.array([_signed(x) for x in node], pa.int64()), pa.array([_signed(x) for x in value], pa.int64()), pa.array(n, pa.int64()),
                    pa.array(linked, pa.int64()), pa.array(named, pa.bool_()),
                    pa.array([p and [_signed(x) for x in p] for p in path], pa.list_(pa.int64())),
                ],
                names=[c.split()[0] for c in COUNTS.split(", ")],
            )


def site_of(url: Column) -> Column:
    """The host a page comes from, in lower case and without port; empty if there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(host, F.lit(""))


def style_tree(counts: DataFrame) -> DataFrame:
    """The site trees: ``site``, ``node``, ``pages``, ``presentation``, ``content``, ``composite`` and ``importance``."""
    once = counts.groupBy("site", "kind", "node", "value", "page").agg(
        F.max("n").alias("n"), F.max("linked").alias("linked"), F.bool_or("named").alias("named"), F.max("path").alias("path")
    )
    spread = once.groupBy("site", "kind", "node", "value").agg(
        F.sum("n").alias("uses"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log("n")).otherwise(0.0)).alias("log_uses"), F.count("*").alias("pages"),
        F.sum("linked").alias("linked"), F.bool_or("named").alias("named"), F.max("path").alias("path"),
    )

    def of(kind: int, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    uses = F.col("uses")
    nodes = written(
        spread.groupBy("site", "node").agg(
            F.count(of(STYLE, uses)).alias("styles"), F.sum(of(STYLE, uses)).alias("shown"), F.sum(of(STYLE, uses * F.log("uses"))).alias("log_shown"),
            F.count(of(TEXT, uses)).alias("texts"), F.coalesce(F.sum(of(TEXT, F.log("uses") - F.col("log_uses") / uses)), F.lit(0.0)).alias("scatter"),
            F.max(of(NODE, F.col("pages"))).alias("pages"), F.sum(of(NODE, uses)).alias("chars"), F.sum(of(NODE, F.col("linked"))).alias("linked"),
            F.bool_or("named").alias("named"), F.max("path").alias("path"),
        )
    )
    several = F.col("pages") > 1
    own = F.col("texts") - F.when(several, F.col("scatter") / F.log("pages")).otherwise(0.0)
    below = (
        nodes.select("site", F.explode("path").alias("node"), own.alias("_own"), "texts", "chars", "linked")
        .groupBy("site", "node").agg(F.sum("_own").alias("_own"), F.sum("texts").alias("_texts"), F.sum("chars").alias("_chars"), F.sum("linked").alias("_linked"))
    )
    presentation = F.when(several, F.least(F.lit(1.0), (F.log("shown") - F.col("log_shown") / F.col("shown")) / F.log("pages"))).otherwise(1.0)
    content = F.when(F.col("_texts") > 0, F.greatest(F.lit(0.0), F.col("_own") / F.col("_texts"))).otherwise(0.0)
    weight = F.pow(F.lit(GAMMA), F.col("styles"))
    inside_links = F.when(~F.col("named") & (F.col("_chars") > 0), F.least(F.lit(1.0), F.col("_linked") / F.col("_chars"))).otherwise(0.0)
    judged = nodes.join(below, ["site", "node"]).select(
        "site", "node", "pages", "named", "path", presentation.alias("presentation"), content.alias("content"),
        (((1 - weight) * F.col("presentation") + weight * F.col("content")) * (1 - inside_links)).alias("composite"),
    )
    step = judged.select("site", F.col("node").alias("_above"), F.struct("pages", "named", "composite").alias("_step"))
    steps = judged.select("site", "node", F.posexplode("path").alias("_at", "_above")).join(step, ["site", "_above"])
    ways = steps.groupBy("site", "node").agg(F.sort_array(F.collect_list(F.struct("_at", "_step"))).alias("_way"))

    def descend(importance: Column, at: Column) -> Column:
        k = F.when(at._step.named, NAMED).otherwise(FEW)
        return (k * importance + at._step.pages * at._step.composite) / (k + at._step.pages)

    return judged.join(ways, ["site", "node"]).select(
        "site", "node", "pages", "presentation", "content", "composite", F.aggregate("_way", F.lit(1.0), descend).alias("importance")
    )


def main_text(page: Page, noisy: set[int]) -> str:
    """The blocks that labels and the site's tree leave, in page order."""
    stay, _ = page.kept()
    keys, _ = page.nodes(stay)
    return " ".join(text for branch, text, _ in page.blocks if stay[branch] and keys[branch] not in noisy)


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The rows of ``pages`` without the html, with the main ``text`` and its ``n_chars``; a column of such a name is replaced."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    keyed = pages.select(F.struct(*kept).alias("_row"), site_of(F.col(url)).alias("site"), F.coalesce(html, F.lit("")).alias("html"))
    keyed = keyed.withColumn("page", F.md5("html"))
    counts = written(keyed.select("site", "page", "html").mapInArrow(_counts_of, COUNTS))
    noise = written(style_tree(counts).where(F.col("importance") < THRESHOLD).select("site", "node"))
    met = counts.where(F.col("kind") == NODE).select("site", "page", "node").join(noise, ["site", "node"])
    noisy = written(met.groupBy("site", "page").agg(F.collect_set("node").alias("noisy")))
    marked = keyed.join(noisy, ["site", "page"], "left").select("_row", "html", "noisy")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [
                    main_text(read_page(html), {x % (1 << 64) for x in noisy or ()})
                    for html, noisy in zip(part.column("html").to_pylist(), part.column("noisy").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_row", "text", "n_chars"])

    row = keyed.select("_row").schema[0].dataType.simpleString()
    return marked.mapInArrow(work, f"_row {row}, text string, n_chars long").select("_row.*", "text", "n_chars")
