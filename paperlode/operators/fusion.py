"""Reciprocal-rank fusion and constraint-aware rescoring."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

RRF_K, CO_OCCURRENCE = 60, 0.15


def reciprocal_rank(vector: DataFrame, keyword: DataFrame, limit: int | None, id_col: str = "chunk_id", k: int = RRF_K, bonus: float = CO_OCCURRENCE) -> DataFrame:
    """Full outer join of two ranked lists; the score is divided by its maximum. Ties: vector rank, keyword rank, id."""
    both = vector.select(id_col, "score_vector", "vector_rank").join(keyword.select(id_col, "score_keyword", "keyword_rank"), id_col, "full_outer")
    v, w = F.col("vector_rank"), F.col("keyword_rank")
    part = lambda r: F.when(r.isNotNull(), 1.0 / (k + r)).otherwise(0.0)
    raw = part(v) + part(w) + F.when(v.isNotNull() & w.isNotNull(), F.lit(bonus)).otherwise(0.0)
    source = F.when(v.isNotNull() & w.isNotNull(), "hybrid").when(v.isNotNull(), "vector").otherwise("keyword")
    out = both.withColumn("score_final", F.least(F.lit(1.0), raw / (2.0 / (k + 1) + bonus))).withColumn("retrieval_source", source)
    order = [F.col("score_final").desc(), v.asc_nulls_last(), w.asc_nulls_last(), F.col(id_col)]
    return out.orderBy(*order).limit(limit) if limit is not None else out


#: Fixed value: how a pH is written.
PH = r"ph([0-9]+(?:\.[0-9]+)?)"


class Texts:
    """A text in the forms that terms are looked up in, made once for a row: `prepared` adds them, `matches` uses them."""

    NAMES = ("_norm", "_compact", "_ph")

    @classmethod
    def prepared(cls, df: DataFrame, text_col: str) -> DataFrame:
        low = F.lower(text_col)
        return df.withColumns({"_norm": T.constraint_text(text_col), "_compact": F.replace(low, F.lit(" "), F.lit("")), "_ph": T.ph_values(text_col)})

    @staticmethod
    def matches(term: str) -> Column | None:
        """A term occurs: normalised, or without blanks, or as an equal pH value. None for a blank term."""
        plain = " ".join(re.sub(r"[^0-9a-zA-Z一-鿿\s.\-]", " ", term.strip().lower()).split())
        if not plain:
            return None
        compact = plain.replace(" ", "")
        found = F.contains("_norm", F.lit(plain)) | F.contains("_compact", F.lit(compact))
        if value := re.search(PH, compact):
            found |= F.array_contains("_ph", value[1])
        return F.coalesce(found, F.lit(False))


def matched(terms: list[str]) -> Column:
    """The terms that occur, in order."""
    tests = [F.when(test, F.lit(t.strip())) for t in terms if (test := Texts.matches(t)) is not None]
    return F.filter(F.array(*tests).cast("array<string>"), lambda x: x.isNotNull())


def once(terms: Column) -> Column:
    """Each string once, equal up to case, the first stays."""
    low = F.transform(terms, lambda x: F.lower(x))
    return F.filter(terms, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def constraint_scores(hits: DataFrame, entities: list[str], conditions: list[str], relations: list[str], groups: list[list[str]], text_col: str = "text", score_col: str = "score_final") -> DataFrame:
    """Adds entity_match, condition_match, relation_match, groups_matched, matched_constraints, missing_constraints, score_constraint
    and a new score_final."""
    groups = [g for g in groups if g]
    df = Texts.prepared(hits, text_col)
    df = df.withColumns({"_e": matched(entities), "_c": matched(conditions), "_r": matched(relations), "_g": F.array(*[matched(g) for g in groups]).cast("array<array<string>>")})
    hit = lambda c: F.size(c) > 0
    names = F.array(*[F.lit(" | ".join(g[:3])) for g in groups]).cast("array<string>")
    df = df.withColumns({
        "entity_match": hit("_e"), "condition_match": hit("_c"), "relation_match": hit("_r"), "groups_matched": F.size(F.filter("_g", hit)),
        "matched_constraints": once(F.concat("_e", "_c", "_r", F.flatten("_g"))),
        "missing_constraints": once(F.filter(F.transform("_g", lambda m, i: F.when(F.size(m) == 0, F.get(names, i))), lambda x: x.isNotNull())),
    })
    e, c, r = F.col("entity_match"), F.col("condition_match"), F.col("relation_match")
    points = lambda flag, x: F.when(flag, F.lit(x)).otherwise(F.lit(0.0))
    share = F.col("groups_matched") / len(groups) if groups else F.lit(0.0)
    score = points(e, 0.25) + points(c, 0.35) + points(r, 0.1) + 0.3 * share + points(e & c, 0.2)
    if groups:
        score = score + points(F.col("groups_matched") == len(groups), 0.1)
    score = F.least(F.lit(1.0), score)
    if conditions:
        score = F.when(c, score).otherwise(score * 0.2)
    if entities:
        score = F.when(e, score).otherwise(score * 0.35)
    df = df.withColumn("score_constraint", score)
    final = 0.55 * F.col(score_col) + 0.45 * F.col("score_constraint") + points(e & c, 0.08) - (points(~c, 0.12) if conditions else F.lit(0.0))
    return df.withColumn("score_final", F.greatest(F.lit(0.0), F.least(F.lit(1.0), final))).drop(*Texts.NAMES, "_e", "_c", "_r", "_g")
