"""Main content of web pages, by the paths that the pages of a host agree on.

Parsed pages keep no tags, so the path of a line is what is left of one: its host and its text with everything that
changes from page to page generalised (numbers, revisions, the site's own name). The steps are

1. *score*: each container (line) gets marks of its own: is it a sentence, a heading, a menu, a copyright;
2. *vote*, in Spark: a path that a good part of a host's pages share is furniture there; a path that is furniture on
   the hosts where most of its pages are is furniture everywhere, which helps hosts of one page. Short lines that vary
   but start alike, and never start a title, are voted on by their opening ("Posted by …");
3. *extract again*: with the winning paths known, each page is read once more. A page given as one text is main content
   from its headline to its last sentence that isn't furniture; a page given as elements is judged by element; a link
   is main content if a main paragraph of the page holds its text.

Votes are aggregated over all pages before they are joined; a host with a third of all pages is spread by path, then by
page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import WS, strip
from brindle.session import cut_lineage, written

#: Lines of a page that are held together; a page of more is judged by joins.
LONG = 5_000
#: Winning paths (8 bytes each) that are broadcast at most; more of them are joined by a shuffle.
MOST_SENT = 100_000
_MENU = re.compile(r"(?:[^|·/>»•]{1,40}(?: [|·/>»] |\s{2,})){2,}[^|·/>»•]{1,40}$")
_RIGHTS = re.compile(r"©|copyright (?:©|\(c\)|\d)", re.I)
_TRAIL = re.compile(r"^(?:/ |.{1,30} [»>/] )")
_SENTENCE_END = (".", "!", "?", "。", "！", "？", ":", "”", '."', ".)")


def generalised(line: Column, site: Column) -> Column:
    """A line without what changes from page to page: tokens with digits are 0, the site's own name is ``{site}``."""
    line = F.lower(strip(line))
    line = F.regexp_replace(line, F.lit("^[•*-] +"), F.lit(""))
    line = F.when(F.length(site) > 2, F.regexp_replace(line, site, F.lit("{site}"))).otherwise(line)
    return F.regexp_replace(line, F.lit(r"[\p{L}]*\d[\p{L}\d.,:]*"), F.lit("0"))


def page_lines(chunks: DataFrame) -> DataFrame:
    """The non-blank lines of rows whose metadata has ``parser = html``, with hashes of host, path, opening and page; written once.

    A row without source is a page of its own.
    """
    meta = lambda k: F.col("metadata")[k]
    rows = chunks.filter((meta("parser") == "html") & F.col("text").isNotNull()).select(
        "chunk_id", F.coalesce("source", F.concat(F.lit("row "), "chunk_id"), F.lit("")).alias("source"), F.coalesce("ordinal", F.lit(0)).alias("ordinal"),
        meta("type").alias("kind"), meta("level").isNotNull().alias("level"), meta("href").isNotNull().alias("href"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )
    rows = rows.filter(F.col("line").rlike(f"[^{WS}]"))
    host = F.lower(F.regexp_extract("source", r"^[a-zA-Z][\w+.-]*://([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    site = F.regexp_extract(F.element_at(labels, F.greatest(F.size(labels) - 1, F.lit(1))), "^([a-z]+)", 1)
    rows = rows.withColumn("path", generalised(F.col("line"), site))
    first = F.substring_index("path", " ", 1)
    start = F.when(first.endswith(":"), first).otherwise(F.substring_index("path", " ", 2))
    short = ~F.col("path").rlike(r"[.!?。！？:]$") & (F.size(F.split("path", " ")) <= 14)
    ids = [F.xxhash64(host).alias("host_id"), F.xxhash64(host, F.col("path")).alias("local_id"), F.xxhash64("path").alias("path_id"), F.xxhash64(start).alias("opening_id")]
    return written(rows.select(*[c for c in rows.columns if c != "path"], *ids, F.xxhash64("source").alias("page_id"), short.alias("short")))


def vote(lines: DataFrame, share: float = 0.2, least_pages: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``local_id`` of paths that win on their host, ``path_id`` of those that win everywhere, ``opening_id`` of varying furniture.

    Only hashes are read, counted and sent: a row per host, path and page at most.
    """
    on = lines.groupBy("host_id", "local_id", "path_id", "page_id").agg(F.lit(1).alias("one")).groupBy("host_id", "local_id", "path_id").agg(F.count(F.lit(1)).alias("pages"))
    whole = lines.groupBy("host_id", "page_id").agg(F.lit(1).alias("one")).groupBy("host_id").agg(F.count(F.lit(1)).alias("all_pages"))
    rated = cut_lineage(on.join(whole, "host_id").withColumn("wins", (F.col("pages") >= least_pages) & (F.col("pages") >= share * F.col("all_pages"))).select("local_id", "path_id", "pages", "wins"))
    local = rated.filter("wins").select("local_id")
    everywhere = rated.groupBy("path_id").agg(F.sum(F.when(F.col("wins"), F.col("pages")).otherwise(0)).alias("won"), F.sum("pages").alias("pages"))
    everywhere = everywhere.filter("2 * won >= pages").select("path_id")
    typed = lines.filter(F.col("kind").isin("title", "heading", "paragraph"))
    paragraph = F.col("kind") == "paragraph"
    forms = typed.groupBy("opening_id", "path_id").agg(F.count_if(~paragraph).alias("titles"), F.count_if(paragraph & F.col("short")).alias("shorts"), F.count_if(paragraph).alias("rows"))
    opened = forms.groupBy("opening_id").agg(*[F.sum(c).alias(c) for c in ("titles", "shorts", "rows")], F.count_if(F.col("shorts") > 0).alias("forms"))
    openings = opened.filter("shorts >= 4 and forms >= 3 and shorts >= 0.8 * rows and titles <= 0.02 * shorts").select("opening_id")
    return local, everywhere, openings


def _marked(lines: DataFrame, winners: DataFrame, key: str, name: str) -> DataFrame:
    """``lines`` with ``name`` true where ``key`` wins; winners are sent to all only if they are few."""
    winners = cut_lineage(winners.distinct())
    few = len(winners.limit(MOST_SENT + 1).select(F.lit(1)).collect()) <= MOST_SENT
    return lines.join((F.broadcast(winners) if few else winners).withColumn(name, F.lit(True)), key, "left")


def _is_sentence(s: str) -> bool:
    return s.endswith(_SENTENCE_END) and (not s.endswith(":") or " " in s)


def _looks_like_furniture(s: str, title: str) -> bool:
    if _RIGHTS.match(s):
        return True
    if title and s != title and s.endswith(title) and _TRAIL.match(s):
        return True
    if s.endswith(".") or not _MENU.match(s):
        return False
    items = re.split(r" [|·/>»•] |\s{2,}", s)
    return "  " not in s or all(x[:1].isupper() for x in items)  # else words set far apart


def _title_of(titled: str | None, top_kind: str | None, top_line: str) -> tuple[str, str]:
    """Title and headline of a page, by its first title and its first line."""
    title = (titled or "").strip()
    if not title and top_kind == "page" and not _looks_like_furniture(top_line.strip(), ""):
        title = top_line.strip()
    return title, re.sub(r" [–—|-] [^–—|]{1,40}$", "", title)


def _kind_of(s: str, kind: str | None, level: bool, href: bool, title: str, head: str) -> str:
    if kind is None:
        return "heading" if level else "link" if href else "title" if s == title or s == head else "paragraph"
    return kind


def _judge(page: list[tuple]) -> Iterator[tuple[str, int]]:
    """The lines of one page that aren't main content. A line: (chunk_id, line_no, text, kind, level, href, furniture)."""
    title, head = _title_of(next((x[2] for x in page if x[3] == "title"), None), *((page[0][3], page[0][2]) if page else (None, "")))
    flat = [x for x in page if x[3] == "page"]
    rest = [x for x in page if x[3] != "page"]

    marked = [(x, s, x[6] or _looks_like_furniture(s, head)) for x in flat for s in (x[2].strip(),)]
    first = next((n for n, (_, s, _) in enumerate(marked) if n > 0 and s == head), None)
    last = max((n for n, (_, s, bad) in enumerate(marked) if not bad and _is_sentence(s)), default=-1)
    if first is None:
        first = next((n for n, (_, s, bad) in enumerate(marked) if n > 0 and not bad and len(s) > 60), len(marked))
    for n, (x, s, bad) in enumerate(marked):
        is_main = (n == 0 and s == title) or n == first or (first < n <= last and not bad)
        if not is_main:
            yield x[0], x[1]

    paragraphs, links = [], []
    for x in rest:
        s, kind = x[2].strip(), x[3]
        kind = _kind_of(s, kind, x[4], x[5], title, head)
        if kind == "title":
            continue
        if kind == "link":
            links.append((x, s))
        elif x[6] or _looks_like_furniture(s, head):
            yield x[0], x[1]
        elif kind != "heading":
            paragraphs.append(s)
    body = "\n".join(paragraphs)
    for x, s in links:
        if x[6] or s not in body:
            yield x[0], x[1]


def _judge_long(lines: DataFrame) -> DataFrame:
    """What ``_judge`` gives, for pages too long to be held: their title, bounds and paragraphs are aggregated and joined."""
    lines = lines.dropDuplicates(["source", "ordinal", "chunk_id", "line_no"]).withColumn("at", F.struct("ordinal", "chunk_id", "line_no"))
    opening = lines.groupBy("source").agg(
        F.min(F.struct("at", "kind", "line")).alias("top"), F.min(F.when(F.col("kind") == "title", F.struct("at", "line"))).alias("titled"),
        F.min(F.when(F.col("kind") == "page", F.col("at"))).alias("begin"),
    )
    opening = opening.select("source", "begin", F.col("top.kind").alias("top_kind"), F.col("top.line").alias("top_line"), F.col("titled.line").alias("title"))
    rows = lines.join(opening, "source").select("source", "ordinal", "chunk_id", "line_no", "line", "kind", "level", "href", "furniture", "top_kind", "top_line", "title", (F.col("at") == F.col("begin")).alias("begins"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line, kind, level, href, furniture, top_kind, top_line, title in zip(*(batch.column(c).to_pylist() for c in ("line", "kind", "level", "href", "furniture", "top_kind", "top_line", "title"))):
                s, title, head = line.strip(), *_title_of(title, top_kind, top_line)
                kind = _kind_of(s, kind, level, href, title, head)
                out.append((s, kind, furniture or (kind not in ("title", "link") and _looks_like_furniture(s, head)), _is_sentence(s), s == title, s == head, len(s) > 60))
            columns = list(zip(*out)) or [()] * 7
            added = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), *(pa.array(c, pa.bool_()) for c in columns[2:])]
            kept = ["source", "ordinal", "chunk_id", "line_no", "begins"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *added], names=[*kept, "s", "role", "bad", "sentence", "is_title", "is_head", "is_long"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = ", ".join(f"{c} {kinds[c]}" for c in ("source", "ordinal", "chunk_id", "line_no", "begins"))
    marked = cut_lineage(rows.mapInArrow(mark, f"{shape}, s string, role string, bad boolean, sentence boolean, is_title boolean, is_head boolean, is_long boolean"))
    flat = marked.filter("role = 'page'").withColumn("at", F.struct("ordinal", "chunk_id", "line_no"))
    bounds = flat.groupBy("source").agg(
        F.coalesce(F.min(F.expr("CASE WHEN NOT begins AND is_head THEN at END")), F.min(F.expr("CASE WHEN NOT begins AND NOT bad AND is_long THEN at END"))).alias("first"),
        F.max(F.expr("CASE WHEN NOT bad AND sentence THEN at END")).alias("last"),
    )
    is_main = F.expr("(begins AND is_title) OR coalesce(at = first, false) OR (coalesce(first < at AND at <= last, false) AND NOT bad)")
    flat = flat.join(bounds, "source").filter(~is_main)
    rest = marked.filter("role not in ('page', 'title')")
    body = rest.filter("role not in ('link', 'heading') and not bad").select(F.col("source").alias("of"), F.col("s").alias("body")).distinct()
    links = rest.filter("role = 'link'")
    named = links.filter("not bad").select("source", "s").distinct().join(body, (F.col("source") == F.col("of")) & F.col("body").contains(F.col("s")), "left_semi")
    links = links.join(named.withColumn("named", F.lit(True)), ["source", "s"], "left").filter("bad or named is null")
    parts = [flat, rest.filter("role <> 'link' and bad"), links]
    out = [x.select("chunk_id", F.col("line_no").cast("bigint").alias("line_no")) for x in parts]
    return out[0].union(out[1]).union(out[2])


def _known_lines(chunks: DataFrame, share: float, least_pages: int) -> tuple[DataFrame, DataFrame | None]:
    """Lines with ``furniture`` true where a winning path says so: those of pages that can be held, and of longer ones, if any."""
    lines = page_lines(chunks)
    local, everywhere, openings = vote(lines, share, least_pages)
    known = _marked(_marked(_marked(lines, local, "local_id", "here"), everywhere, "path_id", "anywhere"), openings, "opening_id", "opens")
    titled = F.coalesce(F.col("kind") == "title", F.lit(False))
    furniture = ~titled & (F.col("here").isNotNull() | F.col("anywhere").isNotNull() | (F.col("opens").isNotNull() & F.col("short")))
    known = known.select("source", "ordinal", "chunk_id", "line_no", "line", "kind", "level", "href", furniture.alias("furniture"))
    long = cut_lineage(lines.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LONG).select("source"))
    if long.isEmpty():
        return known, None
    return known.join(long, "source", "left_anti"), known.join(long, "source")


def furniture_lines(chunks: DataFrame, share: float = 0.2, least_pages: int = 3) -> DataFrame:
    """``chunk_id, line_no`` (from 0) of each line of a web page that isn't main content.

    Rows without ``parser = html`` in their metadata, null and empty texts and blank lines give nothing. A row that is
    repeated counts once. A missing type is read from level and link target, else the row is a paragraph. A row without
    source is a page of its own, without host. Extra columns are ignored. Pages of more than ``LONG`` lines are judged
    by joins, with the same result.
    """
    known, long = _known_lines(chunks, share, least_pages)
    short = _judge_short(known).filter("not main").select("chunk_id", "line_no")
    return short if long is None else short.union(_judge_long(long))


def _judge_short(lines: DataFrame) -> DataFrame:
    """``source, chunk_id, ordinal, line_no, line, main`` by ``_judge``, one page held at a time."""
    laid = lines.repartition("source").sortWithinPartitions("source", "ordinal", "chunk_id", "line_no")
    names = ["source", "chunk_id", "line_no", "line", "kind", "level", "href", "furniture"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, page, met, out = None, [], None, []

        def judged() -> None:
            bad = set(_judge([x[:-1] for x in page]))
            out.extend((now, x[0], x[-1], x[1], x[2], (x[0], x[1]) not in bad) for x in page)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*names, "ordinal")]
            for source, *x in zip(*columns):
                if source != now:
                    judged()
                    now, page, met = source, [], None
                if (x[0], x[1]) != met:  # else a repeated row
                    page.append(tuple(x))
                    met = (x[0], x[1])
            yield _judged(out)
            out.clear()
        judged()
        yield _judged(out)

    return laid.mapInArrow(extract, "source string, chunk_id string, ordinal int, line_no long, line string, main boolean")


def _judged(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 6
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["source", "chunk_id", "ordinal", "line_no", "line", "main"])


def main_text(chunks: DataFrame, share: float = 0.2, least_pages: int = 3) -> DataFrame:
    """``source, chunk_id, ordinal, text``: each web page row with its main lines only; rows without any are left out."""
    known, long = _known_lines(chunks, share, least_pages)
    columns = ["source", "chunk_id", "ordinal", "line_no", "line"]
    kept = _judge_short(known).filter("main").select(columns)
    if long is not None:
        own = long.select("source", "chunk_id", "ordinal", F.col("line_no").cast("long").alias("line_no"), "line").dropDuplicates(["chunk_id", "line_no"])
        kept = kept.union(own.join(_judge_long(long), ["chunk_id", "line_no"], "left_anti").select(columns))
    body = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    own = F.when(~F.startswith("source", F.lit("row ")), F.col("source")).alias("source")
    return kept.groupBy("source", "chunk_id", "ordinal").agg(F.array_join(body, "\n").alias("text")).select(own, "chunk_id", "ordinal", "text")
