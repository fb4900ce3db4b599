"""Operators with several ways through them, against plain loops: nearest rows in blocks, scans cut into spans, postings."""

import random

import numpy as np

from paperlode.operators import judging, lexical, ranking, vector


def test_nearest_rows_in_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=6).tolist()) for i in range(200)] + [(300, None), (301, [0.0] * 6), (302, [1.0, 2.0])]
    data += [(400, data[3][1]), (401, data[3][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    units = {i: np.array(v) / max(np.linalg.norm(v), 1e-8) for i, v in data if v is not None and len(v) == 6}
    want = {}
    for q in range(0, 200, 5):
        best = max((round(float(units[q] @ u), 9), -i) for i, u in units.items() if i != q)
        want[q] = (-best[1], best[0])
    for block in (1 << 15, 7):
        got = {r["query_id"]: (r["match_id"], r["cosine"]) for r in vector.nearest(df, df.where("vec_id < 200 and vec_id % 5 = 0"), block=block).collect()}
        assert got.keys() == want.keys() and all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) < 1e-8 for q in want)
    assert vector.nearest(df, df.limit(0)).count() == 0


def test_early_stop_in_spans(spark):
    r = random.Random(2)
    rows = [(k, i * r.randint(1, 3) + i, r.random() < p) for k, p in ((None, 0.3), ("a", 0.1), ("b", 0.02), ("c", 1.0), ("d", 0.0), ("e", 0.25)) for i in range(r.randint(1, 90))]
    rows = list({(k, i): (k, i, d) for k, i, d in rows}.values())
    df = spark.createDataFrame(rows, "k string, rank long, d boolean")
    for streak, window in ((5, 3), (1, 1), (20, 5)):
        want = {}
        for k in {x[0] for x in rows}:
            scan, run, stop = [d for _, _, d in sorted((x for x in rows if x[0] == k), key=lambda x: x[1])], 0, None
            for n, d in enumerate(scan, 1):
                run = 0 if d else run + 1
                if run == streak:
                    stop = n
                    break
            seen = scan if stop is None else scan[: stop + window - 1]
            want[k] = (len(scan), len(seen), sum(seen), stop is not None)
        for span in (4096, 7, 1):
            got = {x["k"]: tuple(x)[1:] for x in ranking.early_stop(df, "k", "rank", "d", streak, window, span).collect()}
            assert got == want


def test_terms_are_counted_as_tokens_are(spark):
    texts = ["Étude of the étude", "etude-of_the", "études of  the near", "of the. of,the of the", "", None, "a a a", "naïve of the naive"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = {r[0]: r[1] or [] for r in df.select("doc_id", lexical.T.tokens("text")).collect()}
    for phrase in ("etude", "Étude", "of the", "a a", "naive", "the near"):
        words = lexical.tokens_of(phrase)
        want = {i: sum(t[k : k + len(words)] == words for k in range(len(t))) for i, t in tokens.items()}
        got = {r[0]: r[1] or 0 for r in df.select("doc_id", lexical.occurrences(lexical.F.lower("text"), phrase)).collect()}
        assert got == want, phrase
    assert {r["term"]: (r["total"], r["df"]) for r in lexical.term_counts(df).collect()}["etude"] == (3, 2)


def test_phrases_that_are_searched_must_all_be_there(spark):
    df = spark.createDataFrame([(1, "cold water near warm stone"), (2, "cold water warm stone"), (3, "warm stone")], "doc_id long, text string")
    ids = lambda wanted: [r["doc_id"] for r in lexical.search_phrases(df, wanted, 10).collect()]
    assert ids(["cold water", "warm stone"]) == [1] and sorted(ids(['"warm stone"'])) == [1, 2, 3] and ids(["x"]) == ids([]) == []
    assert lexical.query_words("The the THE a1 題目 x") == ["the", "a1", "題目"] and lexical.clean_phrases([" a ", '"ab"', *"cdefgh", "gh"]) == ["ab", "gh"]


def test_answers_as_tables(spark):
    chunk = "struct<chunk_id: string, score_final: double, page_start: int, page_end: int>"
    docs = spark.createDataFrame([("q", "d", 1, "T", [("s-d:0001", 0.2, 0, 0), ("s-d:0002", 0.9, 1, 2)]), ("q", "e", 2, "U", [("s-e:0001", 0.5, 0, 0)]), ("q", "f", 3, "V", [])], f"q string, doc_id string, rank int, title string, chunks array<{chunk}>")
    raw = spark.createDataFrame([("d", "direct_support", "1) Yes.", ["s-d:0001", "s-d:0002", "x"], ["s-d:0001", "s-d:0002"]), ("e", "Direct_Support", "Also.", None, ["s-e:0001"]), ("f", "direct_support", " ", [], [])], "doc_id string, label string, answer_line string, supporting_chunk_ids array<string>, chunk_ids array<string>")
    judged = judging.assessments(raw)
    assert {r["doc_id"]: r["error"] is None for r in judged.collect()} == {"d": True, "e": True, "f": False}
    found = judging.answers(docs, judged).join(docs.select("doc_id", "q"), "doc_id")
    assert judging.assembled(found, "q").first().asDict() == {"q": "q", "answer": "1. Yes.\n\n2. Also.", "citations": "[1] T (pp. 1-2, chunk d:0002; p. 0, chunk d:0001)\n[2] U (p. 0, chunk e:0001)"}
