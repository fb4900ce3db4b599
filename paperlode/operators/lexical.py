"""Full-text retrieval: BM25 over documents or postings, phrase and proximity predicates."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


#: What may stand for a letter before folding.
_LOOKS = {plain: plain + "".join(m for m, p in zip(T.MARKED, T.PLAIN, strict=True) if p == plain) for plain in set(T.PLAIN)}
_WORD = r"[\p{L}\p{N}]"


def query_words(query: str) -> list[str]:
    """What a free-text query asks for: runs of two or more ASCII letters, digits or ideographs, the first twelve distinct ones."""
    return list(dict.fromkeys(w.lower() for w in re.findall(r"[0-9A-Za-z一-鿿]{2,}", query)))[:12]


def clean_phrases(wanted: list[str]) -> list[str]:
    """Phrases of two or more characters, quotes dropped, six at most."""
    return [p for p in (x.strip().replace('"', "") for x in wanted) if len(p) >= 2][:6]


def tokens_of(phrase: str) -> list[str]:
    """The index tokens of a query's phrase: as T.tokens, of a string."""
    return re.findall(r"[^\W_]+", phrase.lower().translate(str.maketrans(T.MARKED, T.PLAIN)))


def occurrences(text: Column, phrase: str) -> Column:
    """How often the tokens of a phrase stand in a row in a lower-cased text, marks aside. No token is cut out: the text is scanned."""
    words = tokens_of(phrase)
    if not words:
        return F.lit(0)
    parts = ["".join(f"[{_LOOKS[c]}]" if c in _LOOKS else re.escape(c) for c in w) for w in words]
    first = f"[{_LOOKS[words[0][0]]}]" if words[0][0] in _LOOKS else re.escape(words[0][0])
    rest = rf"[^\p{{L}}\p{{N}}]+".join([parts[0][len(first) :], *parts[1:]])
    return F.regexp_count(text, F.lit(rf"{first}(?<!{_WORD}.)(?={rest}(?!{_WORD}))"))


def bm25(docs: DataFrame, phrases: list[str], id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """id, bm25 (higher is better) for every document with at least one of the phrases (every: with all); a word is a phrase of one.

    Texts are scanned for the phrases and their tokens counted, not cut; the counts are a narrow table. The corpus statistics
    are one row, joined by broadcast. A phrase that is given twice counts twice.
    """
    low = docs.select(F.col(id_col), F.lower(text_col).alias("_low"))
    distinct = list(dict.fromkeys(phrases))
    words = low.select(id_col, F.regexp_count("_low", F.lit(rf"{_WORD}+")).alias("_n"), *[occurrences(F.col("_low"), p).alias(f"_f{i}") for i, p in enumerate(distinct)])
    stats = words.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(distinct))])
    some = [F.col(f"_f{i}") > 0 for i in range(len(distinct))]
    keep = reduce(operator.and_ if every else operator.or_, some) if some else F.lit(False)
    scored = words.where(keep).crossJoin(F.broadcast(stats))  # one row
    return scored.select(id_col, sum((_term(distinct.index(p)) for p in phrases), F.lit(0.0)).alias("bm25"))


def bm25_postings(postings: DataFrame, corpus: DataFrame, words: list[str], id_col: str = "chunk_id") -> DataFrame:
    """bm25() for single words, from the inverted index: only the words' postings are read. corpus: one row with docs and avg_n."""
    words = [w for p in words for w in tokens_of(p)]
    hits = postings.where(F.col("term").isin(words))
    df = hits.groupBy("term").agg(F.count("*").alias("_df"))  # a row for each of the query's words
    each = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))
    return each.groupBy(id_col).agg(F.sum(_weight(F.col("docs"), F.col("_df"), F.col("tf"), F.col("n_tokens"), F.col("avg_n"))).alias("bm25"))


def _weight(docs: Column, df: Column, tf: Column, n: Column, avg: Column) -> Column:
    idf = F.greatest(F.ln((docs - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
    tf = tf.cast("double")
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / avg))


def _term(i: int) -> Column:
    return _weight(F.col("_docs"), F.col(f"_d{i}"), F.col(f"_f{i}"), F.col("_n"), F.col("_avg"))


def search(docs: DataFrame, terms: list[str], limit: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The best `limit` documents with keyword_rank and the constant keyword score; ties by id. No terms match nothing."""
    found = bm25(docs if terms else docs.limit(0), terms or ["-"], id_col, text_col)
    return listed(found, limit, id_col)


def search_phrases(docs: DataFrame, wanted: list[str], limit: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """search() for documents that hold all phrases (several are joined by the word near, which must occur too)."""
    found = [x for p in clean_phrases(wanted) for x in (p, "near")][:-1]
    return listed(bm25(docs if found else docs.limit(0), found or ["-"], id_col, text_col, every=True), limit, id_col)


def listed(found: DataFrame, limit: int | None, id_col: str) -> DataFrame:
    """id, keyword_rank and score_keyword of the best."""
    return ranked(found.withColumn("bm25", F.round("bm25", 9)), "bm25", "keyword_rank", limit, id_col).withColumn("score_keyword", F.lit(1.0))


def ranked(df: DataFrame, score: str, name: str, limit: int | None, *ties: str) -> DataFrame:
    """Numbers rows by falling score. With a limit the window sees at most that many rows, after a top-k."""
    from pyspark.sql import Window as W

    order = [F.col(score).desc(), *[F.col(t) for t in ties]]
    if limit is not None:
        df = df.orderBy(*order).limit(limit)
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def has_phrase(tokens: Column, phrase: str) -> Column:
    """Whether the tokens of a phrase stand in a row."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f" {phrase} "))


def phrases(docs: DataFrame, wanted: list[str], mode: str = "near", text_col: str = "text") -> DataFrame:
    """Rows that hold all phrases. mode `compat` also asks for the word near, as joining phrases by it in an AND query does."""
    wanted = [p for p in wanted if len(p.strip().strip('"')) >= 2][:6]
    keep = F.lit(bool(wanted))
    for p in wanted + (["near"] if mode == "compat" and len(wanted) > 1 else []):
        keep &= has_phrase(T.tokens(text_col), p)
    return docs.where(keep)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """The inverted index: term, id, tf, positions, n_tokens, and the columns `carried`. The empty term has a row for each
    document, for its length. One shuffle, by term and document, after partial aggregation in each task."""
    words = docs.select(F.col(id_col), *carried, T.tokens(text_col).alias("t")).withColumn("n_tokens", F.size("t"))
    each = words.select(id_col, *carried, "n_tokens", F.posexplode("t").alias("at", "term"))
    found = each.groupBy("term", id_col, *carried).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("positions"), F.max("n_tokens").alias("n_tokens"))
    lengths = words.select(F.lit("").alias("term"), id_col, *carried, F.lit(0).cast("long").alias("tf"), F.array().cast("array<int>").alias("positions"), "n_tokens")
    return found.unionByName(lengths)


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, total, df over all documents: one shuffle, by term, of what each task has summed."""
    words = docs.select(T.tokens(text_col).alias("t"))
    told = F.concat(F.transform("t", lambda x: F.struct(x.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d"))), F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d"))))
    each = words.select(F.explode(told).alias("w"))
    return each.groupBy(F.col("w.term").alias("term")).agg(F.sum("w.n").alias("total"), F.sum("w.d").alias("df"))
