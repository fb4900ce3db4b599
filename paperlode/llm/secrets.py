"""Secret scans in DataFrame operations only: fixed patterns, and a randomness test battery over encoded-looking tokens.

Fixed patterns (kinds assign, access, hex) give the base spans. The battery adds spans of kind `random`:

1. Candidates are maximal runs of 16 or more encoding characters; each gets an inferred encoding (hex, base32,
   base64/base64url, alphanumeric) or none (words, plain numbers). A run that mixes the separators of base64 and base64url
   is cut at those of either; of parts found random that lie in one another the longest counts.
2. Three tests ask whether the token looks drawn at random from that alphabet: chi-squared uniformity, the runs test
   about the alphabet's middle, and lag-1 serial correlation. A token that any of them rejects at RANDOM_LEVEL / 3 is not
   random.
3. What is left must stand out from ordinary text: the p-value that text has so few repeated characters at that length
   (for hex also, that text keeps to those sixteen characters). Short tokens cannot reach small values.
4. Length-aware false-discovery control: within a document the p-values go through a weighted Benjamini-Hochberg step
   whose weights are the token lengths over their mean.

All of it is per row, so nothing is shuffled and no key can be hot. Null and empty texts have no spans; repeated rows are
scanned alike; other columns of the input are not read. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
#: The look-behinds change no match; they spare a try at every character inside a run.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
#: What every ASSIGN match holds, lower-cased.
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Kinds in their order.
KINDS = ("assign", "access", "hex", "random")
RANDOM_LEVEL, DISCOVERY_RATE = 0.001, 0.05
#: Chance that two letters of running text agree, that three do, and that a letter lies in a-f.
PAIR, TRIPLE, HEX_LETTER = 0.066, 0.0054, 0.25

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "base64url": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_",
}

BLOCK = 256


def prefix_sums(array: str) -> str:
    """SQL for the running sums of an array of int, in blocks, so that long arrays cost no quadratic copying."""
    run = "aggregate({0}, cast(array() as array<int>), (s, x) -> array_append(s, coalesce(try_element_at(s, -1), 0) + x))"
    blocks = f"if(size({array}) = 0, array(), transform(sequence(1, size({array}), {BLOCK}), b -> slice({array}, b, {BLOCK})))"
    totals = run.format("transform(bs, b -> aggregate(b, 0, (s, x) -> s + x))")
    inner = run.format("b")
    return (
        f"transform(array({blocks}), bs -> transform(array({totals}), ts -> "
        f"flatten(transform(bs, (b, i) -> transform({inner}, x -> x + if(i = 0, 0, try_element_at(ts, i))))))[0])[0]"
    )


def occurrences(df: DataFrame, name: str, pattern: str, only: Column | None = None) -> DataFrame:
    """Adds <name>: array of struct(s, e, hit) of all leftmost non-overlapping matches in `text`. only: a cheap test that holds wherever there is one."""
    quoted = F.lit(pattern)
    df = df.withColumn("_found", F.col("text").rlike(pattern) if only is None else F.when(only, F.col("text").rlike(pattern)).otherwise(False))
    found = F.col("_found")
    df = df.withColumn("_hits", F.when(found, F.regexp_extract_all("text", quoted, F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_gaps", F.when(found, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_step", F.expr("transform(_hits, (h, i) -> length(h) + length(_gaps[i]))"))
    df = df.withColumn("_ends", F.expr(prefix_sums("_step")))
    return df.withColumn(name, F.expr("transform(_hits, (h, i) -> struct(_ends[i] - length(h) as s, _ends[i] as e, h as hit))")).drop("_found", "_hits", "_gaps", "_step", "_ends")


def normal(z: str) -> str:
    """SQL for the standard normal distribution function (Abramowitz and Stegun 7.1.26)."""
    x = f"(abs({z}) / sqrt(2D))"
    t = f"(1 / (1 + 0.3275911D * {x}))"
    tail = f"(({t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D))))) * exp(-{x} * {x}) / 2)"
    return f"if({z} > 0, 1 - {tail}, {tail})"


def tested(df: DataFrame) -> DataFrame:
    """From _cand (struct(s, e, hit)): adds _tests, with the battery's results for every candidate that has an encoding."""
    encoding = """case
        when t rlike '^[0-9a-f]+$' and t rlike '[0-9]' and t rlike '[a-f]' then 'hex'
        when t rlike '^[0-9A-F]+$' and t rlike '[0-9]' and t rlike '[A-F]' then 'hex'
        when t rlike '^[A-Z2-7]+$' and t rlike '[2-7]' and t rlike '[A-Z]' then 'base32'
        when not (t rlike '[A-Za-z]') or not (t rlike '[0-9]' or t rlike '[a-z][A-Z]') then null
        when t rlike '^[A-Za-z0-9]+$' then 'alnum'
        when t rlike '^[A-Za-z0-9+/]+$' then 'base64'
        when t rlike '^[A-Za-z0-9_-]+$' then 'base64url' end"""
    alphabet = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in ALPHABETS.items()) + " end"
    let = lambda df, expr: df.withColumn("_tests", F.expr(expr))
    df = let(df, "transform(_cand, c -> struct(cast(c.s as long) as s, cast(c.e as long) as e, rtrim('=', c.hit) as t))")
    # a run with separators of both base64 alphabets has no encoding: its parts between either's separators are candidates
    pieces = """aggregate(split(c.t, '{0}'), struct(c.s as at, cast(array() as array<struct<s: bigint, e: bigint, t: string>>) as out),
        (a, p) -> struct(a.at + length(p) + 1 as at, if(length(p) >= 16, array_append(a.out, struct(a.at as s, if(a.at + length(p) = c.s + length(c.t), c.e, a.at + length(p)) as e, p as t)), a.out) as out), a -> a.out)"""
    df = let(df, f"flatten(transform(_tests, c -> if(c.t rlike '[+/]' and c.t rlike '[_-]', array_distinct(concat({pieces.format('[+/]')}, {pieces.format('[_-]')})), array(c))))")
    df = let(df, f"filter(transform(_tests, c -> transform(array(c.t), t -> struct(c.s as s, c.e as e, length(t) as n, {encoding} as kind, t as t))[0]), c -> c.kind is not null and c.n >= 16)")
    df = let(df, f"transform(_tests, c -> transform(array(c.kind), kind -> struct(c.s as s, c.e as e, c.n as n, kind as kind, if(kind = 'hex', lower(c.t), c.t) as t, {alphabet} as letters))[0])")
    df = let(df, """transform(_tests, c -> struct(c.s as s, c.e as e, cast(c.n as double) as n, c.kind as kind, cast(length(c.letters) as double) as k,
        transform(filter(split(c.letters, ''), x -> x <> ''), x -> cast(length(c.t) - length(replace(c.t, x, '')) as double)) as counts,
        transform(filter(split(c.t, ''), x -> x <> ''), x -> cast(instr(c.letters, x) - 1 as double)) as v))""")
    df = let(df, """transform(_tests, c -> struct(c.s as s, c.e as e, c.n as n, c.kind as kind, c.k as k, c.v as v,
        aggregate(c.counts, 0D, (a, x) -> a + x * x) as squares,
        aggregate(c.v, 0D, (a, x) -> a + x) / c.n as mean,
        aggregate(c.v, 0D, (a, x) -> a + if(x > (c.k - 1) / 2, 1D, 0D)) as high,
        aggregate(c.v, struct(cast(null as boolean) as last, 0D as runs), (a, x) -> struct(x > (c.k - 1) / 2 as last, a.runs + if(a.last is null or a.last <> (x > (c.k - 1) / 2), 1D, 0D) as runs)).runs as runs))""")
    df = let(df, """transform(_tests, c -> struct(c.s as s, c.e as e, c.n as n, c.kind as kind, c.squares as squares,
        (c.k / c.n * c.squares - c.n - (c.k - 1)) / sqrt(2 * (c.k - 1) * (c.n - 1) / c.n) as z_uniform,
        2 * c.high * (c.n - c.high) / c.n as mixed, c.runs as runs,
        aggregate(c.v, 0D, (a, x) -> a + (x - c.mean) * (x - c.mean)) as spread,
        aggregate(c.v, struct(cast(null as double) as last, 0D as sum), (a, x) -> struct(x as last, a.sum + coalesce((a.last - c.mean) * (x - c.mean), 0D) as sum)).sum as lagged))""")
    df = let(df, f"""transform(_tests, c -> struct(c.s as s, c.e as e, c.n as n, c.kind as kind, c.z_uniform as z_uniform,
        if(c.mixed * (c.mixed - 1) > 0, (c.runs - c.mixed - 1) / sqrt(c.mixed * (c.mixed - 1) / (c.n - 1)), 99D) as z_runs,
        if(c.spread > 0, (c.lagged / c.spread + 1 / c.n) * sqrt(c.n), 99D) as z_serial,
        ((c.squares - c.n) / 2 + 0.5 - c.n * (c.n - 1) / 2 * {PAIR}D) / sqrt(c.n * (c.n - 1) / 2 * ({PAIR}D - {PAIR}D * {PAIR}D) + c.n * (c.n - 1) * (c.n - 2) * ({TRIPLE}D - {PAIR}D * {PAIR}D)) as z_text))""")
    return let(df, f"""transform(_tests, c -> struct(c.s as s, c.e as e, c.n as n, c.kind as kind,
        least(1 - {normal('c.z_uniform')}, 2 * (1 - {normal('abs(c.z_runs)')}), 2 * (1 - {normal('abs(c.z_serial)')})) as p_random,
        {normal('c.z_text')} * if(c.kind = 'hex', pow({HEX_LETTER}D, c.n), 1D) as p_text))""")


def discovered(df: DataFrame) -> DataFrame:
    """Adds _random: the candidates that pass the battery and the weighted false-discovery step."""
    df = df.withColumn("_mean", F.expr("aggregate(_tests, 0D, (a, c) -> a + c.n) / greatest(size(_tests), 1)"))
    df = df.withColumn("_sorted", F.expr("array_sort(transform(_tests, c -> c.p_text * _mean / c.n))"))
    df = df.withColumn("_bar", F.expr(f"array_max(transform(_sorted, (q, i) -> if(q <= (i + 1) * {DISCOVERY_RATE}D / size(_sorted), q, -1D)))"))
    return df.withColumn("_random", F.expr(f"filter(_tests, c -> c.p_text * _mean / c.n <= _bar and c.p_random >= {RANDOM_LEVEL / 3}D)")).withColumn("_random", F.expr("filter(_random, c -> not exists(_random, d -> d.s <= c.s and d.e >= c.e and d.e - d.s > c.e - c.s))")).drop("_mean", "_sorted", "_bar")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and `found`: array of struct(s, o, e) over all kinds, sorted by start and then kind (o: its place in KINDS)."""
    df = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scanned(df)


def scanned(df: DataFrame) -> DataFrame:
    """scan() for a frame whose `text` is not null; every other column stays."""
    df = df.withColumn("_lower", F.lower("text"))
    df = occurrences(df, "_assign", ASSIGN, functools.reduce(operator.or_, (F.contains("_lower", F.lit(w)) for w in WORDS))).drop("_lower")
    df = df.withColumn("_assign", F.filter("_assign", lambda c: F.length(F.regexp_extract(c["hit"], ASSIGN, 2)) >= 6))
    df = occurrences(df, "_cand", CANDIDATE)
    some = F.size("_cand") > 0  # the other two kinds lie inside candidate runs
    df = occurrences(occurrences(df, "_access", ACCESS, some), "_hex", HEX, some)
    df = discovered(tested(df))
    parts = [f"transform(_{k}, c -> struct(cast(c.s as int) as s, {o} as o, cast(c.e as int) as e))" for o, k in enumerate(KINDS)]
    return df.withColumn("found", F.expr(f"array_sort(concat({', '.join(parts)}))")).drop("_assign", "_access", "_hex", "_cand", "_tests", "_random")


def written(found: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({found}, c -> concat({names}[c.o], ':', c.s, ':', c.e)), ',')")


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from scan()'s."""
    count = lambda o: F.expr(f"cast(size(filter(found, c -> c.o = {o})) as long)")
    return df.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written("filter(found, c -> c.o < 3)").cast("binary"), 256).alias("base_sha256"), written("found").alias("spans"), count(3).alias("n_random"))


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span of `text` (overlapping ones together) by a mark; the other columns stay, whatever their names. Null
    texts stay null. The parts are collected in order and joined once."""
    found = scanned(df.select(F.struct(*df.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text")))
    # spans that touch or overlap are one: their bounds, in order
    found = found.withColumn("found", F.expr("filter(found, c -> c.e > c.s)"))
    found = found.withColumn("reach", F.expr(RUNNING))
    found = found.withColumn("cuts", F.expr("filter(transform(found, (c, i) -> struct(c.s as s, if(i = 0, -1, reach[i - 1]) as before, i as i)), c -> c.s >= c.before)"))
    found = found.withColumn("cuts", F.expr("transform(cuts, (c, k) -> struct(if(k = 0, 0, c.before) as a, c.s as b))"))
    parts = f"concat(array_join(transform(cuts, c -> concat(substring(text, c.a + 1, c.b - c.a), '{mark}')), ''), substring(text, reach[size(reach) - 1] + 1))"
    clean = F.when(F.col("row.text").isNull() | (F.size("found") == 0), F.col("row.text")).otherwise(F.expr(parts))
    return found.select(*[clean.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in df.columns])


#: SQL: the farthest end so far, for every span of `found`; in blocks, so that many spans cost no quadratic copying.
RUNNING = prefix_sums("transform(found, c -> c.e)").replace("coalesce(try_element_at(s, -1), 0) + x", "greatest(coalesce(try_element_at(s, -1), 0), x)").replace("(s, x) -> s + x", "(s, x) -> greatest(s, x)").replace("x -> x + if(i = 0, 0, try_element_at(ts, i))", "x -> greatest(x, if(i = 0, 0, try_element_at(ts, i)))")
