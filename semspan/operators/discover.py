"""Discovery in a data lake: summaries of tables, a lexical and a vector index, and hybrid search.

Search takes a frame of queries and ranks the documents of every query at once. Lexical scores are
BM25 (k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5))), vector scores exact cosines. Each side proposes
``pool_factor * topk`` documents per query, both sides' scores of all proposed documents are scaled to 0..1 per
query, and ``alpha * lexical + (1 - alpha) * vector`` decides.

Queries are taken in blocks of at most ``QUERY_BLOCK``, which is all that travels to the tasks. For each block the index
is scanned twice in place, once for the frequencies of the block's terms and once for the scores: a task scores its documents
against the whole block, as sparse sums and dense products, and lets go of all but the best of each query. No pair of
a term and a document is ever exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semspan.backends import Backend, current_backend
from semspan.functions.columns import lexical_tokens, merge_segments
from semspan.operators.core import Ledger
from semspan.operators.evaluate import Question, ask, truth
from semspan.runtime import fresh_name, numbered, reliable_checkpoint

K1, B = 1.2, 0.75
MAX_SUMMARY = 4096
TYPES = ("COLUMN", "RECORD", "CONTEXT")


def record_summary(df: DataFrame, n_records: int = 5, seed: int = 42, key: str | None = None, max_length: int = MAX_SUMMARY) -> DataFrame:
    """One row ``record_summary``: ``n_records`` sampled rows as 'col: val | …', joined by ' || '."""
    text = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns])
    order = F.xxhash64(F.col(f"`{key}`") if key else text, F.lit(seed))
    picked = df.select(text.alias("r"), order.alias("o")).orderBy("o", "r").limit(n_records)
    rows = picked.agg(F.array_sort(F.collect_list(F.struct("o", "r"))).alias("rows"))
    return rows.select(merge_segments(F.transform("rows", lambda x: x["r"]), max_length, truncate=True).alias("record_summary"))


def summarize(
    tables: DataFrame, column_names: str = "column_names", backend: Backend | None = None, model: str | None = None,
    ledger: Ledger | None = None, max_length: int = MAX_SUMMARY,
) -> DataFrame:
    """Appends ``column_summary``: a model's description of the columns of each table ('name: text || …')."""
    names = F.array_join(F.col(column_names), ", ")
    question = Question("summarize", "Describe each column in one sentence.", ("columns",), ("str",))
    asked = tables.withColumn("__a", ask(question, [names], backend, model, when=F.size(column_names) > 0))
    asked = ledger.watch(asked, "__a") if ledger else asked
    segments = F.split(F.get("__a.values", F.lit(0)), r"\s*\|\|\s*")
    return asked.withColumn("column_summary", merge_segments(segments, max_length, truncate=True)).drop("__a")


def vectorize(
    summaries: DataFrame, table_id: str = "table_id", backend: Backend | None = None, stem: bool = True, ledger: Ledger | None = None
) -> DataFrame:
    """(doc_id, table_id, type, document, vector, tokens): one row per summary that is not null.

    ``summaries`` has column_summary, record_summary and context.
    """
    parts = F.array(
        *[
            F.struct(F.lit(t).alias("type"), F.col(c).alias("document"))
            for t, c in zip(TYPES, ("column_summary", "record_summary", "context"))
        ]
    )
    docs = summaries.select(F.col(f"`{table_id}`").alias("table_id"), F.explode(parts).alias("d")).select("table_id", "d.*")
    docs = docs.filter("document is not null").withColumn("doc_id", F.concat(F.col("table_id").cast("string"), F.lit("_"), F.lower("type")))
    return embed(docs, "document", "vector", backend, ledger).withColumn("tokens", lexical_tokens(F.col("document"), stem))


def embed(
    df: DataFrame, text_col: str, vector_col: str = "vector", backend: Backend | None = None, ledger: Ledger | None = None
) -> DataFrame:
    """Appends the embedding of a text; null for null. What it costs is watched like the cost of a question."""
    chosen = backend or current_backend()

    @F.pandas_udf("struct<vector:array<float>,cost:double,calls:int,status:string>")
    def vectors(texts: pd.Series) -> pd.DataFrame:
        known = texts.notna().to_numpy().nonzero()[0]
        out = [{"vector": None, "cost": 0.0, "calls": 0, "status": "skipped"} for _ in range(len(texts))]
        got, cost = chosen.embed_with_cost(texts.iloc[known].tolist()) if len(known) else ([], 0.0)
        for n, (i, v) in enumerate(zip(known, got)):
            out[i] = {"vector": v, "cost": cost if n == 0 else 0.0, "calls": int(n == 0), "status": "ok"}
        return pd.DataFrame(out, columns=["vector", "cost", "calls", "status"])

    answer = fresh_name(df, "embedded")
    done = df.withColumn(answer, vectors.asNondeterministic()(F.col(f"`{text_col}`")))
    done = ledger.watch(done, answer) if ledger else done
    return done.withColumn(vector_col, F.col(f"`{answer}`.vector")).drop(answer)


#: Queries that are scored together, and the scores and sums a task holds at once.
QUERY_BLOCK = 1_024
SCORES_AT_ONCE = 2_000_000
SUMS_AT_ONCE = 4_000_000
_BETWEEN = chr(1)
#: Digits of a score that count in an order.
DIGITS = 9


def _index(docs: DataFrame, id_col: str, tokens_col: str, vector_col: str) -> DataFrame:
    """(id, words, vector), written once: it is scanned twice for every block of queries."""
    tokens = F.array_join(F.col(tokens_col), _BETWEEN) if tokens_col in docs.columns else F.lit(None).cast("string")
    vector = F.col(vector_col).cast("array<double>") if vector_col in docs.columns else F.lit(None).cast("array<double>")
    return reliable_checkpoint(docs.select(F.col(id_col).alias("id"), tokens.alias("words"), vector.alias("vector")))


def _blocks_of(queries: DataFrame) -> Iterator[pa.Table]:
    """The queries (query_id, tokens, vector), at most ``QUERY_BLOCK`` at a time."""
    tokens = F.array_distinct("tokens") if "tokens" in queries.columns else F.lit(None).cast("array<string>")
    vector = F.col("vector").cast("array<double>") if "vector" in queries.columns else F.lit(None).cast("array<double>")
    own = reliable_checkpoint(queries.select("query_id", tokens.alias("tokens"), vector.alias("vector")))
    n = own.count()
    if n <= QUERY_BLOCK:
        if n:
            yield own.toArrow()
        return
    ordered = reliable_checkpoint(numbered(own, [F.col("query_id")], "__no"))
    for at in range(0, n, QUERY_BLOCK):
        yield ordered.filter((F.col("__no") > at) & (F.col("__no") <= at + QUERY_BLOCK)).drop("__no").toArrow()


class QueryBlock:
    """A block of queries as arrays: for each term the queries that have it, and the unit vectors by their length."""

    def __init__(self, table: pa.Table):
        self.ids = table["query_id"].to_pylist()
        self.id_type = table["query_id"].type
        pairs = [(t, q) for q, tokens in enumerate(table["tokens"].to_pylist()) for t in tokens or () if t is not None]
        self.terms = sorted({t for t, _ in pairs})
        place = {t: i for i, t in enumerate(self.terms)}
        order = sorted((place[t], q) for t, q in pairs)
        self.of_term = np.array([q for _, q in order], dtype=np.int64)
        self.start = np.searchsorted(np.array([t for t, _ in order], dtype=np.int64), np.arange(len(self.terms) + 1))
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for q, v in enumerate(table["vector"].to_pylist()):
            if v and None not in v and np.isfinite(v).all():
                by_length.setdefault(len(v), []).append((q, np.array(v)))
        self.vectors = {d: (np.array([q for q, _ in found]), _unit(np.stack([v for _, v in found]))) for d, found in by_length.items()}

    def postings(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, term, tf) of every term of the block in some documents, and the length of each document."""
        split = pc.split_pattern(words, _BETWEEN)
        empty = pc.fill_null(pc.equal(words, ""), True).to_numpy(zero_copy_only=False)
        length = np.where(empty, 0, pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
        parents = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.index_in(pc.list_flatten(split), value_set=pa.array(self.terms, pa.string()))
        hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
        term = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
        key, tf = np.unique(parents[hit] * max(1, len(self.terms)) + term, return_counts=True)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), tf.astype(float), length


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _frequencies(index: DataFrame, block: QueryBlock) -> tuple[int, float, np.ndarray]:
    """(documents with words, their mean length, documents of each term of the block), added up in each task first."""
    terms = len(block.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2)
        for batch in batches:
            _, term, _, length = block.postings(batch.column(0))
            total[:terms] += np.bincount(term, minlength=terms)[:terms]
            total[terms:] += (length > 0).sum(), length.sum()
        used = np.flatnonzero(total)
        yield pa.record_batch({"i": used, "n": total[used]})

    found = index.select("words").mapInArrow(count, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(terms + 2)
    total[found["i"].to_numpy()] = found["n"].to_numpy()
    n = int(total[terms])
    return n, total[terms + 1] / n if n else 1.0, total[:terms]


class _Best:
    """The ``k`` best documents of every query so far, with equals of the last: more come out than ``k``, never fewer."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.floor = k, np.full(n_queries, -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def offer(self, order: np.ndarray, valid: np.ndarray, at: np.ndarray, *carried: np.ndarray) -> None:
        """``order`` is documents x queries; ``at`` numbers the documents, ``carried`` are matrices of the same shape."""
        order = np.where(valid, np.round(order, DIGITS), -np.inf)
        if len(order) >= self.k:
            self.floor = np.maximum(self.floor, np.partition(order, len(order) - self.k, axis=0)[len(order) - self.k])
        d, q = np.nonzero((order >= self.floor) & valid)
        self.held.append((q, order[d, q], at[d], *[c[d, q] for c in carried]))
        self.size += len(d)
        if self.size > SUMS_AT_ONCE:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        columns = tuple(np.concatenate(c) for c in zip(*self.held)) if self.held else ()
        if columns and len(columns[0]):
            order = np.lexsort((-columns[1], columns[0]))
            q, score = columns[0][order], columns[1][order]
            first = np.searchsorted(q, q)
            last = np.minimum(first + self.k - 1, np.searchsorted(q, q, side="right") - 1)
            columns = tuple(c[order[score >= score[last]]] for c in columns)
        self.held, self.size = [columns] if columns else [], len(columns[0]) if columns else 0
        return columns


def _proposals(index: DataFrame, block: QueryBlock, k: int, text: bool, vector: bool, k1: float, b: float) -> DataFrame:
    """(query_id, id, text_score, vector_score, by_text, by_vector): of each task, what may be among the ``k`` best of a side."""
    n_docs, mean, df = _frequencies(index, block) if text else (0, 1.0, np.zeros(0))
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    n = len(block.ids)
    id_kind = index.schema["id"].dataType.simpleString()
    query_ids = pa.array(block.ids, block.id_type)

    def text_scores(words: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, scores) of runs of documents."""
        doc, term, tf, length = block.postings(words)
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
        reach = block.start[term + 1] - block.start[term]
        rows = max(1, SCORES_AT_ONCE // n)
        at = 0
        while at < len(words):
            lo = np.searchsorted(doc, at)
            hi = np.searchsorted(doc, at + rows)
            sums = np.cumsum(reach[lo:hi])
            if len(sums) and sums[-1] > SUMS_AT_ONCE:  # fewer documents, at least one
                to = int(doc[lo + np.searchsorted(sums, SUMS_AT_ONCE)])
                to = max(at + 1, to)
                hi = np.searchsorted(doc, to)
            else:
                to = min(at + rows, len(words))
            r = reach[lo:hi]
            inner = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
            q = block.of_term[np.repeat(block.start[term[lo:hi]], r) + inner]
            cell = np.repeat(doc[lo:hi] - at, r) * n + q
            yield at, np.bincount(cell, weights=np.repeat(weight[lo:hi], r), minlength=(to - at) * n).astype(float).reshape(-1, n)
            at = to

    def vector_scores(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        scores, valid = np.zeros((len(vectors), n)), np.zeros((len(vectors), n), dtype=bool)
        length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        for d, (queries, unit) in block.vectors.items():
            rows = np.flatnonzero(length == d)
            if len(rows):
                x = np.asarray(vectors.take(pa.array(rows)).flatten(), dtype=float).reshape(-1, d)
                finite = np.isfinite(x).all(axis=1)
                scores[np.ix_(rows, queries)] = np.where(finite[:, None], _unit(np.where(finite[:, None], x, 0.0)) @ unit.T, 0.0)
                valid[np.ix_(rows, queries)] = finite[:, None]
        return scores, valid

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {"by_text": _Best(n, k), "by_vector": _Best(n, k)}
        ids, seen = [], 0
        for batch in batches:
            ids.append(batch.column(0))
            words, vectors = batch.column(1), batch.column(2)
            runs = text_scores(words) if text else ((at, None) for at in range(0, len(words), max(1, SCORES_AT_ONCE // n)))
            for at, said in runs:
                rows = len(said) if said is not None else min(max(1, SCORES_AT_ONCE // n), len(words) - at)
                said = said if said is not None else np.zeros((rows, n))
                near, valid = vector_scores(vectors.slice(at, rows)) if vector else (np.zeros((rows, n)), None)
                places = np.arange(seen + at, seen + at + rows)
                if text:
                    sides["by_text"].offer(said, said > 0, places, said, near)
                if vector:
                    sides["by_vector"].offer(near, valid, places, said, near)
            seen += batch.num_rows
        for side, best in sides.items():
            columns = best.shrink()
            if columns and len(columns[0]):
                q, _, at, said, near = columns
                own = pa.chunked_array(ids).take(pa.array(at)).combine_chunks()
                yes = pa.array(np.full(len(q), True))
                no = pa.array(np.full(len(q), False))
                yield pa.record_batch(
                    [query_ids.take(pa.array(q)), own, pa.array(said, pa.float64()), pa.array(near, pa.float64()), yes if side == "by_text" else no, yes if side == "by_vector" else no],
                    names=["query_id", "id", "text_score", "vector_score", "by_text", "by_vector"],
                )

    kind = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}[block.id_type]
    return index.mapInArrow(
        search, f"query_id {kind}, id {id_kind}, text_score double, vector_score double, by_text boolean, by_vector boolean"
    )


def _searched(docs, queries, k, text, vector, id_col, tokens_col, vector_col, k1=K1, b=B) -> DataFrame | None:
    index = _index(docs, id_col, tokens_col if text else "", vector_col if vector else "")
    found = None
    for table in _blocks_of(queries):
        some = _proposals(index, QueryBlock(table), k, text, vector, k1, b)
        found = some if found is None else found.unionByName(some)
    return found


def _best(scores: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, DIGITS)), "id")
    return scores.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= k).drop("__rn")


def _nothing(docs: DataFrame, queries: DataFrame, id_col: str, columns: str) -> DataFrame:
    kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    return docs.sparkSession.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, {columns}")


def lexical_search(
    docs: DataFrame, queries: DataFrame, topk: int = 10, id_col: str = "doc_id", tokens_col: str = "tokens", k1: float = K1, b: float = B
) -> DataFrame:
    """(query_id, id, text_score): of every query (query_id, tokens) the ``topk`` documents of highest BM25 that share a term."""
    found = _searched(docs, queries, topk, True, False, id_col, tokens_col, "", k1, b)
    if found is None:
        return _nothing(docs, queries, id_col, "text_score double")
    return _best(found.select("query_id", "id", "text_score"), "text_score", topk)


def vector_search(docs: DataFrame, queries: DataFrame, topk: int = 10, id_col: str = "doc_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, id, vector_score): of every query (query_id, vector) the ``topk`` documents of highest cosine, exactly.

    Vectors of another length, and those with nulls or values that are not finite, take no part; an all-zero one scores 0.
    """
    found = _searched(docs, queries, topk, False, True, id_col, "", vector_col)
    if found is None:
        return _nothing(docs, queries, id_col, "vector_score double")
    return _best(found.select("query_id", "id", "vector_score"), "vector_score", topk)


def _scaled(score: str) -> Column:
    each = Window.partitionBy("query_id")
    low, high = F.min(score).over(each), F.max(score).over(each)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0)


def hybrid_search(
    docs: DataFrame, queries: DataFrame, topk: int = 10, pool_factor: int = 3, alpha: float = 0.5, id_col: str = "doc_id"
) -> DataFrame:
    """(query_id, id, score, position). ``docs`` has tokens and vector; ``queries`` (query_id, tokens, vector)."""
    pool = topk * pool_factor
    found = _searched(docs, queries, pool, True, True, id_col, "tokens", "vector")
    if found is None:
        return _nothing(docs, queries, id_col, "score double, position int")
    found = reliable_checkpoint(found)  # both sides' best are read from it
    said = _best(found.filter("by_text"), "text_score", pool)
    near = _best(found.filter("by_vector"), "vector_score", pool)
    both = said.unionByName(near).groupBy("query_id", "id").agg(F.max("text_score").alias("text_score"), F.max("vector_score").alias("vector_score"))
    score = alpha * _scaled("text_score") + (1 - alpha) * _scaled("vector_score")
    scored = both.withColumn("score", score)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "id")
    ranked = scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= topk)
    return ranked.select("query_id", "id", F.round("score", 6).alias("score"), "position")


def rerank(
    found: DataFrame, docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", backend: Backend | None = None,
    model: str | None = None, ledger: Ledger | None = None,
) -> DataFrame:
    """Relevant documents first, otherwise in their order. ``queries`` has (query_id, text), ``docs`` (id, document)."""
    rows = found.join(docs.select(F.col(id_col).alias("id"), "document"), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    question = Question("relevance", "Is the data set relevant to the query?", ("document", "query"), ("str", "str"))
    asked = rows.withColumn("__a", ask(question, [F.col("document"), F.col("query")], backend, model))
    asked = ledger.watch(asked, "__a") if ledger else asked
    order = Window.partitionBy("query_id").orderBy(F.desc("relevant"), "position")
    judged = asked.withColumn("relevant", truth(F.get("__a.values", F.lit(0))))
    return judged.withColumn("position", F.row_number().over(order)).select("query_id", "id", "score", "relevant", "position")


def as_result(found: DataFrame) -> DataFrame:
    """(query_id, table_ids, scores, types) in order of ``position``."""
    return found.select(
        "query_id",
        F.regexp_extract("id", r"^(.*)_[a-z]+$", 1).alias("table_ids"),
        F.col("score").alias("scores"),
        F.upper(F.regexp_extract("id", r"_([a-z]+)$", 1)).alias("types"),
        "position",
    )
