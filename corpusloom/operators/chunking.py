"""Chunks of documents (C)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_tokens, prose_words_per_kchar

#: Texts that a worker cuts at a time.
TEXTS = 64


def chunk_tokens(docs: DataFrame, size: int, overlap: int | None = None) -> DataFrame:
    """Windows of size tokens, overlap (a tenth by default, half at most) apart; the last one is the first to reach the end.

    (id, chunk_index, text, char_start, char_end, token_length); a token is a run of non-space with the space before it.
    """
    overlap = min(size // 10 if overlap is None else overlap, size // 2)
    stride = max(1, size - overlap)
    toks = F.regexp_extract_all("text", F.lit(r"(\s*\S+)"), 1)
    # exploded as one value, so that filters stay above it and no expression takes the tokens from the text again
    rows = docs.select("id", F.explode(F.array(toks)).alias("t")).where(F.size("t") > 0)
    n = F.size("t")
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")

    def window(i: Column) -> Column:
        part = F.slice("t", i * stride + 1, size)
        step = F.array_join(F.slice("t", i * stride + 1, stride), "")  # what the next window begins behind
        return F.struct(F.array_join(part, "").alias("text"), F.size(part).alias("token_length"), F.length(step).alias("step"))

    rows = rows.select("id", F.transform(F.sequence(F.lit(0), last), window).alias("w"))
    rows = rows.select("id", F.posexplode("w").alias("chunk_index", "x"))
    before = Window.partitionBy("id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("x.step").over(before), F.lit(0)).cast("int").alias("char_start")
    rows = rows.select("id", "chunk_index", "x.text", start, "x.token_length")
    return rows.select("id", "chunk_index", "text", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "token_length")


def headings_to_paths(segments: DataFrame) -> DataFrame:
    """Segments (id, pos, level or null, text) with the path of headings above them; a heading ends deeper ones."""
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = segments
    for i in range(1, 7):
        at = F.last(F.when(F.col("level") == i, F.struct("pos", "text")), ignorenulls=True).over(w)
        rows = rows.withColumn(f"h{i}", at)
    kept, newest = [], F.lit(-1)
    for i in range(1, 7):
        here = F.when(F.col(f"h{i}.pos") > newest, F.col(f"h{i}.text"))
        kept.append(here)
        newest = F.greatest(newest, F.coalesce(F.col(f"h{i}.pos"), F.lit(-1)))
    return rows.select("id", "pos", "level", "text", F.array_join(F.array_compact(F.array(*kept)), " > ").alias("section_path"))


def split_to_budget(text: str, cap: int) -> list[str]:
    """Pieces of at most cap characters that join to text: at paragraphs, else lines, else sentences, else anywhere."""
    if len(text) <= cap:
        return [text] if text else []
    for mark in ("\n\n", "\n", ". "):
        at = text.rfind(mark, 1, cap - len(mark) + 1)
        if at > 0:
            cut = at + len(mark)
            break
    else:
        cut = cap
    out = [text[:cut]]
    rest = text[cut:]
    while rest:
        for mark in ("\n\n", "\n", ". "):
            at = rest.rfind(mark, 1, cap - len(mark) + 1)
            if at > 0 and len(rest) > cap:
                cut = at + len(mark)
                break
        else:
            cut = min(cap, len(rest))
        out.append(rest[:cut])
        rest = rest[cut:]
    return out


def chunk_budget(docs: DataFrame, cap: int, splitter: Callable[[str, int], list[str]] = split_to_budget) -> DataFrame:
    """Each document cut to a budget of characters by a splitter of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few texts at a time, so that a worker never holds the pieces of a whole batch
        for b in (part.slice(at, TEXTS) for part in batches for at in range(0, len(part), TEXTS)):
            rows = [(i, k, t) for i, text in enumerate(b.column("text").to_pylist()) for k, t in enumerate(splitter(text or "", cap))]
            ids = b.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_pydict({"id": ids, "chunk_index": pa.array([r[1] for r in rows], pa.int32()), "text": pa.array([r[2] for r in rows], pa.string())})

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, chunk_index int, text string")


def drop_number_chunks(chunks: DataFrame, docs: DataFrame, least: float = 3.0, max_chars: int = 1_000_000) -> DataFrame:
    """Chunks (id, strategy, chunk_index, text) without those that are mostly numbers, of long texts and tables.

    Of a document (id, doc_type, text) with more than max_chars characters, body chunks with fewer than least words in
    1,000 characters go; the wordiest one always stays, and summary chunks are spared.
    """
    long = docs.where(F.col("doc_type").isin("text", "table") & (F.length("text") > max_chars)).select("id", F.lit(True).alias("long"))
    body = ~F.startswith(F.coalesce("strategy", F.lit("")), F.lit("summary"))
    rows = chunks.join(long, "id", "left").withColumn("body", body).withColumn("prose", prose_words_per_kchar(F.coalesce("text", F.lit(""))))
    best = F.row_number().over(Window.partitionBy("id", "body").orderBy(F.desc("prose"), "chunk_index"))
    return rows.withColumn("best", best).where(F.col("long").isNull() | ~F.col("body") | (F.col("prose") >= least) | (F.col("best") == 1)).select(*chunks.columns)


def replace_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing chunks without those of a document and strategy that new has, and new."""
    return existing.join(new.select("id", "strategy").distinct(), ["id", "strategy"], "left_anti").unionByName(new)


def list_chunks(chunks: DataFrame, where: Column, n: int, offset: int = 0) -> DataFrame:
    """C8."""
    return chunks.where(where).orderBy("id", "chunk_index").offset(offset).limit(n)


def embed_chunks(chunks: DataFrame, embed: Callable[[pd.Series], list[list[float]]]) -> DataFrame:
    """(chunk_id, embedding) by a function on a series of texts, in Arrow batches; ids stay as they are, nulls among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = pa.array([list(map(float, v)) for v in embed(b.column("text").to_pandas())], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_pydict({"chunk_id": b.column("chunk_id"), "embedding": vectors})

    return chunks.select("chunk_id", "text").mapInArrow(run, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, embedding array<float>")


def hashing_embedder(dimension: int = 64) -> Callable[[pd.Series], list[list[float]]]:
    """The default embedder: counts of hashed words, to unit length."""

    def embed(texts: pd.Series) -> list[list[float]]:
        import zlib

        import numpy as np

        out = []
        for t in texts:
            v = np.zeros(dimension, np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1 if h >> 31 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out

    return embed


def heading_segments(docs: DataFrame) -> DataFrame:
    """Markdown texts as segments (id, pos, level, title, text): a segment begins with a heading outside a fence.

    What stands before the first heading has level null. A heading that is a link gives its label, without an edit mark.
    """
    lines = docs.select("id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    upto = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fenced = F.sum(F.startswith("line", F.lit("```")).cast("int")).over(upto) % 2 == 1
    level = F.length(F.regexp_extract("line", r"^(#{1,6})[ \t]+\S", 1))
    rows = lines.withColumn("level", F.when(~fenced & (level > 0), level)).withColumn("pos", F.sum(F.col("level").isNotNull().cast("int")).over(upto))
    raw = F.regexp_extract("line", r"^#{1,6}[ \t]+(.+?)[ \t]*$", 1)
    label = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^\[(.*)\]\([^)]*\)$", "$1"), r"\s*\[\s*edit\s*\]\s*$", ""))
    rows = rows.withColumn("title", F.when(F.col("level").isNotNull(), label))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("id", "pos").agg(F.max("level").alias("level"), F.max("title").alias("title"), text.alias("text"))


def chunk_sections(docs: DataFrame, budget: int, least: float = 0.6) -> DataFrame:
    """(id, chunk_index, section_path, text, page_start, page_end): sections of Markdown texts, small neighbours merged up to a budget of tokens.

    A chunk goes on with the next segment while it has less than least of the budget and both fit; but a heading of level
    1 begins a new chunk, unless all before it is headings. The path is that of the chunk's first segment. Longer segments
    stay whole here: C3 cuts them. Empty texts give no chunks.
    """
    segments = heading_segments(docs)
    paths = headings_to_paths(segments.select("id", "pos", "level", F.col("title").alias("text"))).select("id", "pos", "section_path")
    rows = segments.join(paths, ["id", "pos"]).where("trim(text) <> ''")
    bare = F.col("level").isNotNull() & ~F.contains("text", F.lit("\n"))
    part = F.struct("pos", F.coalesce("level", F.lit(0)).alias("level"), "section_path", "text", count_tokens(F.col("text")).alias("n"), bare.alias("bare"))
    kind = "array<struct<section_path:string,text:string,n:int,bare:boolean>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        goes_on = (F.size(acc) > 0) & (last["n"] < least * budget) & (last["n"] + x["n"] <= budget) & ((x["level"] != 1) | last["bare"])
        joined = F.struct(last["section_path"].alias("section_path"), F.concat(last["text"], F.lit("\n"), x["text"]).alias("text"), (last["n"] + x["n"]).alias("n"), (last["bare"] & x["bare"]).alias("bare"))
        fresh = F.struct(x["section_path"].alias("section_path"), x["text"].alias("text"), x["n"].alias("n"), x["bare"].alias("bare"))
        return F.when(goes_on, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    chunks = rows.groupBy("id").agg(F.aggregate(F.array_sort(F.collect_list(part)), F.array().cast(kind), add).alias("c"))
    return page_ranges(chunks.select("id", F.posexplode("c").alias("chunk_index", "x")).select("id", "chunk_index", "x.section_path", "x.text"))


#: Fixed value: what a parser puts where a page begins.
PAGE_MARK = r"<!-- page:(\d+) -->"


def page_ranges(chunks: DataFrame) -> DataFrame:
    """Chunks (id, chunk_index, text) with page_start and page_end: the pages in effect at the first and the last letter.

    A page is in effect from its mark on; chunks follow each other by chunk_index. Both are null where no mark has come yet.
    """
    marks = F.regexp_extract_all("text", F.lit(PAGE_MARK), 1)
    before = Window.partitionBy("id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("__last", F.try_element_at(marks, F.lit(-1)).cast("long"))
    at = F.regexp_extract("text", "^" + PAGE_MARK, 1)
    rows = rows.withColumn("page_start", F.when(at != "", at.cast("long")).otherwise(F.last("__last", ignorenulls=True).over(before)))
    return rows.withColumn("page_end", F.coalesce("__last", "page_start")).drop("__last")


def enforce_budget(chunks: DataFrame, tokens: int, cap: int, splitter: Callable[[str, int], list[str]] = split_to_budget) -> DataFrame:
    """C4: chunks (id, chunk_index, text) with those above so many tokens cut to cap characters, numbered anew in order."""
    over = F.coalesce(count_tokens(F.col("text")), F.lit(0)) > tokens
    place = F.struct("id", "chunk_index")
    cut = chunk_budget(chunks.where(over).select(place.alias("id"), "text"), cap, splitter).select("id.id", "id.chunk_index", F.col("chunk_index").alias("part"), "text")
    both = chunks.where(~over).select("id", "chunk_index", F.lit(0).alias("part"), "text").union(cut)
    number = F.row_number().over(Window.partitionBy("id").orderBy("chunk_index", "part")) - 1
    return both.select("id", number.alias("chunk_index"), "text")


def chunk_records(docs: DataFrame, cap: int, splitter: Callable[[str, int], list[str]] = split_to_budget) -> DataFrame:
    """One chunk for each image or table record and each summary; one above cap characters is cut."""
    records = docs.where(F.col("doc_type").isin("image", "table")).select("id", F.col("doc_type").alias("strategy"), "text")
    if "summary" in docs.columns:
        records = records.union(docs.where("summary <> ''").select("id", F.lit("summary"), "summary"))
    whole = records.where(F.length("text") <= cap).select("id", "strategy", F.lit(0).alias("chunk_index"), "text")
    cut = chunk_budget(records.where(F.length("text") > cap).select(F.struct("id", "strategy").alias("id"), "text"), cap, splitter)
    return whole.union(cut.select("id.id", "id.strategy", "chunk_index", "text"))


#: Chunkers by strategy: each takes (id, text) and gives (id, chunk_index, text).
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "tokens": lambda docs: chunk_tokens(docs, 400).select("id", "chunk_index", "text"),
    "section": lambda docs: chunk_sections(docs, 400).select("id", "chunk_index", "text"),
    "budget": lambda docs: chunk_budget(docs, 2000),
}


def chunk_documents(docs: DataFrame, strategy: str = "tokens", existing: DataFrame | None = None, cap: int = 2000) -> DataFrame:
    """(id, strategy, chunk_index, text): records by their type, texts by strategy, by tokens where that gives none.

    An unknown strategy falls back to tokens. Chunks of existing stay unless their document and strategy are made anew.
    """
    texts = docs.where(~F.col("doc_type").isin("image", "table")).select("id", "text")
    made = STRATEGIES.get(strategy, STRATEGIES["tokens"])(texts).withColumn("strategy", F.lit(strategy if strategy in STRATEGIES else "tokens"))
    if strategy != "tokens" and strategy in STRATEGIES:
        left = texts.join(made.select("id").distinct(), "id", "left_anti")
        made = made.unionByName(STRATEGIES["tokens"](left).withColumn("strategy", F.lit("tokens")))
    new = made.select("id", "strategy", "chunk_index", "text").union(chunk_records(docs, cap))
    return new if existing is None else replace_chunks(existing, new)


def nearby_text(items: DataFrame, most: int = 2) -> DataFrame:
    """Tables and pictures (id, pos) with the last text items before them, in reading order; items (id, pos, kind, text)."""
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when((F.col("kind") == "text") & (F.col("text") != ""), F.col("text"))
    # texts are numbered and fetched by number, so that no row carries all texts before it
    texts = items.where(said.isNotNull()).select("id", F.row_number().over(Window.partitionBy("id").orderBy("pos")).alias("n"), "text")
    count = F.sum(said.isNotNull().cast("int")).over(before)
    rows = items.withColumn("n", F.coalesce(count, F.lit(0))).where(F.col("kind").isin("table", "picture"))
    steps = rows.select("id", "pos", F.explode_outer(F.when(F.col("n") > 0, F.sequence(F.greatest(F.col("n") - most + 1, F.lit(1)), F.col("n")))).alias("n"))
    found = steps.join(texts, ["id", "n"], "left").groupBy("id", "pos").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("n", "text")))).alias("t"))
    return found.select("id", "pos", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("nearby"))
