"""The pipeline against a brute-force version of its five stages; odd columns, ids and texts through each stage."""

import hashlib
import math
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import decontam, langid, line_dedup, mixing, near_copies, pii, simhash, url_filter
from tests.llm.test_llm_operators import brute_align, brute_components, brute_fingerprint, brute_lines, brute_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[^\x20\x09-\x0D]+"


def corpus() -> tuple[list[tuple], list[tuple]]:
    """Documents in two made-up languages with copies, shared lines, leaked items, junk; and test items."""
    rng = np.random.default_rng(11)
    syllables = {"aa": ["ba", "do", "ki", "lu", "me"], "zz": ["sch", "vrou", "tzel", "gny", "oph"]}
    vocabulary = {lang: ["".join(rng.choice(s, rng.integers(2, 5))) for _ in range(400)] for lang, s in syllables.items()}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    items = [(i, prose("aa", 30)) for i in range(3)] + [(7, None), (8, "")]
    texts = [("aa" if i % 3 else "zz", "\n".join(prose("aa" if i % 3 else "zz", 25) for _ in range(3))) for i in range(60)]
    texts += [texts[4], texts[4], (texts[5][0], texts[5][1].replace("\n", " ")), (texts[5][0], texts[5][1].replace("\n", "  ").upper())]
    texts += [("aa", f"{texts[7][1]}\n{prose('aa', 60)}"), ("zz", f"{texts[9][1][:-1]}\n{prose('zz', 60)}")]
    leaked = items[1][1].split()
    texts += [("aa", f"{prose('aa', 40)} {items[0][1]} {prose('aa', 40)}"), ("aa", f"{prose('aa', 40)} {' '.join(w for i, w in enumerate(leaked) if i % 8 != 5)}")]
    texts += [("aa", None), ("aa", ""), ("aa", "12 34 !!"), (None, prose("aa", 50)), (None, "ქართული დამწერლობა " * 20), ("zz", f"{prose('zz', 3000)}")]
    return [(i, t, lang, [None, "s1", "s2", "s3"][i % 4], len(t or "")) for i, (lang, t) in enumerate(texts)], items


def brute(docs: list[tuple], items: list[tuple], model: langid.Model) -> tuple[dict, list[int]]:
    """doc_id -> (text, source) after four stages, and how many documents each kept."""
    rows, left = {d: (t, s) for d, t, _, s, _ in docs if model.predict(t)[1] >= langid.REJECT}, []
    left.append(len(rows))
    cut = brute_lines([(d, t) for d, (t, _) in rows.items()], line_dedup.EDIT_CHARS)
    rows = {d: (cut[d], s) for d, (t, s) in rows.items() if cut[d] == t or re.search(SPACE, cut[d])}
    left.append(len(rows))
    prints = {d: brute_fingerprint(t) for d, (t, _) in rows.items()}
    roots = brute_components(sorted(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    rows = {d: v for d, v in rows.items() if roots[d] == d}
    left.append(len(rows))
    asked = [w for _, t in items if len(w := decontam.words_of(t or "")) >= decontam.WIDTH]
    rows = {d: v for d, v in rows.items() if not any(brute_align(a, decontam.words_of(v[0])) >= decontam.MIN_SCORE * 2 * len(a) for a in asked)}
    return rows, [*left, len(rows)]


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    model = langid.train(spark.createDataFrame(docs, DOCS).where(langid.learnable()))
    rows, left = brute(docs, items, model)
    assert all(a > b for a, b in zip([len(docs), *left], left)), left
    sizes, total = {d: len(re.findall(SPACE, t)) for d, (t, _) in rows.items()}, {}
    for d, (_, s) in rows.items():
        total[s] = total.get(s, 0) + sizes[d]
    target = brute_targets(total)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(rows)
    for d, (text, s) in rows.items():
        r, times = got[d], target[s] / total[s]
        draw = int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:8], 16) / 2**32
        taken = math.floor(times) * sizes[d] + min(math.floor((times - math.floor(times)) * sizes[d] + draw), sizes[d])
        assert (r["text"], r["n_chars"], r["size"], r["source_size"], r["taken"]) == (text, len(text), sizes[d], total[s], taken)
        assert math.isclose(r["target"], target[s], rel_tol=1e-9)
        words, part = re.findall(SPACE, text), re.findall(SPACE, r["part"] or "")
        assert r["whole"] * sizes[d] + len(part) == taken and len(part) < max(1, sizes[d])
        assert not part or any((words + words)[at : at + len(part)] == part for at in range(len(words)))


CLASHING = ("lang_pred", "SCORE", "n_lines", "n_dropped", "_dkey", "_Drop", "_lines", "_source", "component_id", "fingerprint", "dkey", "_spans", "_text_key", "features", "grams")


def test_stages_keep_columns_and_values_of_any_name(spark, data):
    rows, _ = corpus()
    rows = [*rows[:12], rows[3], (None, rows[4][1], None, None, None), (None, None, None, None, None), (500, "", "aa", "s1", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for stage_rows in (docs, docs.limit(0)):
        now = stage_rows
        for _, step in corpus_pipeline.STAGES[:-1]:
            now = step(spark, now, data)
            assert now.columns == docs.columns
            assert all(r[name] == f"own {name}" for r in now.collect() for name in CLASHING)
        last = corpus_pipeline.STAGES[-1][1](spark, now, data)
        assert set(docs.columns) <= set(last.columns) and all(r["_source"] == "own _source" for r in last.collect())


def test_url_filter_keeps_columns_of_the_model_s_names(spark):
    pages = spark.createDataFrame([(1, "http://example.net/de/9", 5, "x", "y"), (2, None, None, None, None)], "page_id long, url string, features long, prediction string, rawPrediction string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.labelled_urls(spark)).collect()}
    assert (got[1]["features"], got[1]["prediction"], got[1]["rawPrediction"], got[1]["verdict"]) == (5, "x", "y", "allow")
    assert got[2]["host"] == "" and got[2]["features"] is None


def test_masking_goes_by_text(spark):
    rows = [(1, "mail a@b.example now", "o"), (1, "nothing here", "o"), (1, "ip 10.0.0.1", "o"), (None, "mail a@b.example now", "o"), (2, None, "o"), (3, "", "o")]
    got = pii.mask(spark.createDataFrame(rows, "doc_id long, text string, _spans string"))
    assert got.columns == ["doc_id", "text", "_spans"]
    assert sorted(map(str, (r["text"] for r in got.collect()))) == sorted(["mail <email> now", "nothing here", "ip <ip>", "mail <email> now", "None", ""])
    assert simhash.dedup(got).columns == got.columns


def test_near_copies_stage_verifies_and_finds_random_edits(spark):
    rng, rows, near = np.random.default_rng(5), [], set()
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    jaccard = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(100, 1000)))]
        for kind, share in enumerate((0, 0.005, 0.01, 0.02, 0.1)):
            now = [f"e{rng.integers(0, 10**6)}" if rng.random() < share else w for w in words]
            rows.append((1000 * kind + i, " ".join(now), None, "s", 0))
            if kind and jaccard(words, now) >= 0.8:
                near.add(1000 * kind + i)
    rows += [(9000, "x y z " * 200 + "end", None, "s", 0), (9001, "X y  z " * 200 + "end", None, "s", 0), (9002, "a b", None, "s", 0), (9003, "a c", None, "s", 0), (None, "a b", None, "s", 0)]
    by = {r[0]: r[1].split() for r in rows}
    left = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    gone = set(by) - left
    print("near copies gone", len(near & gone), "of", len(near))
    assert len(near & gone) >= 0.99 * len(near) and {9001} <= gone and {9000, 9002, 9003, None} <= left
    assert all(any(jaccard(by[d], by[d % 1000 + 1000 * k]) >= 0.8 for k in range(d // 1000)) for d in gone - {9001})


def test_near_copies_among_many_documents_that_share_a_passage(spark):
    """A passage that 400 different documents share must not hide near copies among them, nor take a round for each."""
    rng, rows, near = np.random.default_rng(6), [], set()
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = word(150)
    for i in range(400):
        own = word(100)
        rows.append((i, " ".join(passage + own), None, "s", 0))
        if i % 10 == 0:
            at = int(rng.integers(0, 100))
            rows.append((1000 + i, " ".join(passage + own[:at] + word(1) + own[at + 1 :]), None, "s", 0))
            near.add(1000 + i)
    left = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    gone = {r[0] for r in rows} - left
    print("near copies beside a shared passage gone", len(near & gone), "of", len(near))
    assert gone <= near and len(near & gone) >= 0.95 * len(near)


@pytest.mark.parametrize("limits", [{}, {"PAIRS": 0, "EACH": 0, "COMMON": 0}])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, limits):
    """Documents that share most of their text with hundreds of others, near copies at the least similarity, edits of a document that comes late: none is lost, whatever the limits."""
    for name, value in limits.items():
        monkeypatch.setattr(near_copies, name, value)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, base, texts = word(180), word(120), []
    for _ in range(250):
        texts.append(passage + word(70))
        if rng.random() < 0.5:
            now = list(texts[-1])
            for at in rng.choice(np.arange(2, 248), 5, replace=False):
                now[at] = word(1)[0]
            texts.append(now)
    for _ in range(60):
        texts.append([w if rng.random() > 0.02 else word(1)[0] for w in base])
    texts += [["a", "b"], ["a", "c"], [], ["A", "b"], []]
    order = rng.permutation(len(texts)).tolist()
    sets = [{" ".join(t[i : i + 5]).lower() for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    want = {i for i in range(len(texts)) if any(near(sets[order[i]], sets[order[j]]) for j in range(i))}
    docs = spark.createDataFrame([(i, " ".join(texts[k]), None, "s", 0) for i, k in enumerate(order)], DOCS)
    left = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    gone = set(range(len(texts))) - left
    print("near copies of all pairs", len(want), "missed", len(want - gone), "wrongly gone", len(gone - want))
    assert gone == want


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_near_copies_read_whole_sets_of_few_pairs_that_are_none(spark, monkeypatch, similarity):
    """Different documents of all lengths that share passages by chance, and edits down to the least similarity: sets are read of hardly more pairs than are near copies, and none is lost."""
    rng, asked, staged = np.random.default_rng(9), [], near_copies.stage

    def counted(df, name):
        out = staged(df, name)
        if name == "sets":
            asked.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "stage", counted)
    monkeypatch.setattr(near_copies, "COMMON", 0)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passages, texts = [word(6) for _ in range(60)], []
    for _ in range(400):
        texts.append([w for k in rng.choice(60, 6, replace=False) for w in [*passages[k], *word(int(rng.integers(8, 12)))]])
        if len(texts) % 8 == 0:
            now, kind = list(texts[-1]), len(texts) % 3
            for at in rng.choice(len(now), kind, replace=False):
                now[at] = word(1)[0]
            texts.append(now + word(int(rng.integers(0, 22))) if kind else now[int(rng.integers(1, 20)) :])
    order = rng.permutation(len(texts)).tolist()
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if len(sets[order[i]] & sets[order[j]]) >= similarity * len(sets[order[i]] | sets[order[j]])}
    docs = spark.createDataFrame([(i, " ".join(texts[k]), None, "s", 0) for i, k in enumerate(order)], DOCS)
    left = {r["doc_id"] for r in near_copies.keep_first(docs, similarity).collect()}
    print("near pairs", len(near), "sets read", asked)
    assert set(range(len(texts))) - left == {i for i, _ in near} and len(near) > 20
    assert sum(asked) <= 2 * 2 * len(near) + 20
