"""Keyword and vector search, their merge, and filters on payload columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, tokens
from ..sources.shared import written

#: Fixed values of BM25.
K1, B = 1.2, 0.75
#: Terms of all questions together that are sent to every task.
QUESTION_TERMS = 200_000


def bm25(docs: DataFrame, terms: list[str], every: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_terms, score) of documents with one of ``terms`` (with all of them, if ``every``).

    One pass counts the terms in each document and writes narrow rows; one row of totals (documents, mean length,
    documents by term) is broadcast to a second pass over those. Texts are read once and not shuffled.
    """
    own = docs.select(key, tokens(F.coalesce(text, F.lit(""))).alias("t"))
    tf = [F.size(F.col("t")) - F.size(F.array_remove("t", w)) for w in terms]
    counted = written(own.select(key, F.size("t").alias("dl"), *[c.alias(f"tf{k}") for k, c in enumerate(tf)]), "counts")
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    both = counted.filter(reduce(lambda a, b: a & b if every else a | b, [F.col(f"tf{k}") > 0 for k in range(len(terms))])).crossJoin(F.broadcast(totals))
    parts = []
    for k in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        parts.append(idf * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    found = reduce(lambda a, b: a + b, [(F.col(f"tf{k}") > 0).cast("long") for k in range(len(terms))])
    return both.select(key, found.alias("n_terms"), F.round(reduce(lambda a, b: a + b, parts), 4).alias("score"))


def top(df: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def similarity(vectors: DataFrame, query: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vectors`` with ``score``, the inner product with the one row of ``query``."""
    q = query.select(F.col(embedding).alias("_q")).limit(1)
    return vectors.crossJoin(F.broadcast(q)).withColumn("score", F.round(dot(F.col(embedding), F.col("_q")), 6)).drop("_q")


def top_each(df: DataFrame, k: int, group: str, key: str, score: str = "score") -> DataFrame:
    """The best ``k`` rows of each group; each task keeps its own best ``k`` before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def hybrid_merge(vector: DataFrame, keyword: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two hit lists: the larger score, and where a hit came from."""
    v, k = vector.select(key, F.col("score").alias("v")), keyword.select(key, F.col("score").alias("k"))
    kind = F.when(F.col("v").isNull(), "keyword").when(F.col("k").isNull(), "vector").otherwise("hybrid")
    return v.join(k, key, "full_outer").select(key, F.greatest("v", "k").alias("score"), kind.alias("search_type"))


def hybrid_weighted(vector: DataFrame, keyword: DataFrame, key: str, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Both lists normalised by their maximum and added with weights."""

    def scaled(hits: DataFrame, name: str) -> DataFrame:
        most = hits.agg(F.max("score").alias("most"))  # one row
        return hits.crossJoin(F.broadcast(most)).select(key, (F.col("score") / F.col("most")).alias(name))

    both = scaled(vector, "v").join(scaled(keyword, "k"), key, "full_outer")
    total = weights[0] * F.coalesce("v", F.lit(0.0)) + weights[1] * F.coalesce("k", F.lit(0.0))
    return both.select(key, F.round(total, 4).alias("score"))


def payload_filter(columns: dict[str, str], wanted: dict[str, object]) -> Column:
    """Conjunction of conditions: a list means any of, ``x_excluded`` means not; arrays match by any element."""
    out = F.lit(True)
    for name, value in wanted.items():
        refused = name.endswith("_excluded")
        name = name.removesuffix("_excluded")
        own = F.col(name)
        many = list(value) if isinstance(value, (list, tuple)) else [value]
        hit = F.arrays_overlap(own, F.array(*map(F.lit, many))) if columns[name].startswith("array") else own.isin(many)
        out &= ~F.coalesce(hit, F.lit(False)) if refused else F.coalesce(hit, F.lit(False))
    return out


def neighbours(chunks: DataFrame, doc: str, index: str, text: str, reach: int = 2, mark: str = ">>> ") -> DataFrame:
    """Each chunk with the texts of its neighbours of the same document, the chunk itself marked."""
    w = Window.partitionBy(doc).orderBy(index)
    n = F.count("*").over(w.rowsBetween(-reach, 0)) - 1  # neighbours before it
    own = F.collect_list(text).over(w.rowsBetween(-reach, reach))
    marked = F.transform("_own", lambda x, k: F.when(k == F.col("_n"), F.concat(F.lit(mark), x)).otherwise(x))
    return chunks.withColumns({"_n": n, "_own": own}).withColumn("context", F.array_join(marked, "\n---\n")).drop("_n", "_own")


def overlap_top(docs: DataFrame, questions: DataFrame, k: int, key: str = "doc_id", ask: str = "item_id") -> DataFrame:
    """(ask, key, hits, n): for each question the ``k`` documents that share most terms with it; equal ones by key.

    Both sides hold a column ``t`` of distinct terms. The questions are a stated set: their terms are counted first and,
    up to ``QUESTION_TERMS``, sent to every task, which meets each document once, keeps its own best ``k`` of each
    question and gives back no more. Larger sets meet the documents by term.
    """
    terms = questions.select(ask, F.size("t").alias("n"), F.explode("t").alias("term"))
    rows = terms.limit(QUESTION_TERMS + 1).toArrow()
    best = F.row_number().over(Window.partitionBy(ask).orderBy(F.desc("hits"), key))
    if rows.num_rows > QUESTION_TERMS:
        d = docs.select(key, F.explode("t").alias("term"))
        found = d.join(terms, "term").groupBy(ask, key).agg(F.count("*").alias("hits"), F.first("n").alias("n"))
        return found.withColumn("_rn", best).filter(F.col("_rn") <= k).drop("_rn")
    schema = f"{ask} {questions.schema[ask].dataType.simpleString()}, {key} {docs.schema[key].dataType.simpleString()}, hits long, n long"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words = pc.unique(rows["term"].combine_chunks())
        items, item = np.unique(rows[ask].to_numpy(), return_inverse=True)
        size = np.zeros(len(items), dtype=np.int64)
        size[item] = rows["n"].to_numpy()
        word = pc.index_in(rows["term"].combine_chunks(), words).to_numpy()
        order = np.argsort(word, kind="stable")
        begin, asks = np.searchsorted(word[order], np.arange(len(words) + 1)), item[order]
        kept: list = [np.zeros(0, dtype=np.int64) for _ in range(3)]  # question, document, hits
        for batch in batches:
            ids, t = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            place = pc.index_in(t.flatten(), words)
            own = pc.list_parent_indices(t).to_numpy()[place.is_valid().to_numpy(zero_copy_only=False)]
            at = place.drop_null().to_numpy()
            times = begin[at + 1] - begin[at]
            pos = np.repeat(begin[at] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
            pairs, hits = np.unique(np.repeat(own, times).astype(np.int64) * len(items) + asks[pos], return_counts=True)
            new = [pairs % len(items), ids[pairs // len(items)], hits]
            kept = [np.concatenate([a, b]) for a, b in zip(kept, new)]
            order = np.lexsort([kept[1], -kept[2], kept[0]])
            kept = [x[order] for x in kept]
            nth = np.arange(len(kept[0])) - np.searchsorted(kept[0], kept[0])
            kept = [x[nth < k] for x in kept]
        yield pa.RecordBatch.from_pydict({ask: pa.array(items[kept[0]]), key: pa.array(kept[1]), "hits": pa.array(kept[2]), "n": pa.array(size[kept[0]])})

    found = docs.select(key, "t").filter(F.col(key).isNotNull()).mapInArrow(run, schema)
    return found.withColumn("_rn", best).filter(F.col("_rn") <= k).drop("_rn")
