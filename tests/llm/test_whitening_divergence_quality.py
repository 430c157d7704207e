"""Whitening, source divergence and quality rules against brute force, and their edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from orderlens.llm import divergence, quality_rules, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- Whitening ----------------------------------------------------------------------------------------------------


def brute_whiten(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 10**6
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    z = x - sums / n
    v = z.T @ z / n
    values, q = np.linalg.eigh(v)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return deviation, z @ q / np.sqrt(values), values / np.trace(v)


def matches(got, want):
    return np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-7


def test_whitening_against_a_full_decomposition(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = sorted(table.collect(), key=lambda r: r["vec_id"])
    deviation, white, explained = brute_whiten([r["embedding"] for r in rows], 32)
    got = whitening.op11_whitening(spark, data).toPandas()
    assert len(got) == 32 * len(rows) and set(got["n"]) == {len(rows)}
    wide = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert matches(wide, white)
    first = got[got.component == 1].sort_values("vec_id")
    assert first["deviation"].tolist() == deviation.tolist()
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_whitening_edges(spark):
    rng = np.random.default_rng(3)
    plain = [[float(x) for x in rng.standard_normal(3)] for _ in range(40)]
    other = [[float(x) for x in rng.standard_normal(2)] for _ in range(9)]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [0.0, float("-inf"), 0.0], [1e300, 0.0, 0.0]]
    rows = [(i, v, 1.0, 2) for i, v in enumerate(plain + other + bad)] + [(None, plain[0], 1.0, 2), (1, plain[1], 1.0, 2)]
    out, fits = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v double, n int"))
    got = out.collect()
    assert {d: f["n"] for d, f in fits.items()} == {3: 42, 2: 9} and len(got) == 51
    mine = sorted((r for r in got if r["d"] == 3), key=lambda r: (r["vec_id"] is None, r["vec_id"]))
    by_id = {r["vec_id"]: r for r in mine}
    deviation, white, _ = brute_whiten(plain + [plain[0], plain[1]], 3)
    assert matches(np.array([by_id[i]["whitened"] for i in range(40)]), white[:40]) and by_id[None]["deviation"] == deviation[0]
    assert all(f["identity_error"] < 1e-9 for f in fits.values())
    # without variance there is no component; one vector deviates by nothing
    same, fits = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    assert {(r["deviation"], len(r["whitened"])) for r in same.collect()} == {(0, 0)} and fits[2]["n"] == 2
    none, fits = whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.count() == 0 and not fits
    # deviations beyond a long
    wide, _ = whitening.whiten(spark.createDataFrame([(i, [1e9 * i, float(i % 2)]) for i in range(50)], "vec_id long, embedding array<double>"))
    assert any(r["deviation"] is None for r in wide.collect())


def test_counts_and_clusters():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    values = np.array([9, 9, 9, 7, 7 - 1e-10, 5, 4, 4 - 1e-3, 3, 2] + [1] * 10 + [0] * 4, float)
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    for shift in (-0.5, 0.5, 1.5, 3.9, 4.5, 6, 8, 10):
        assert whitening.above(v, shift) == (values > shift).sum()
    # zero diagonals need pivots of two rows
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and whitening.above(np.array([[0.0, 2.0, 1.0], [2.0, 0.0, 1.0], [1.0, 1.0, 0.0]]), 0.0) == 1
    found, vectors = whitening.eigen(v, 24)
    assert np.allclose(found, values[:20]) and np.abs(vectors @ vectors.T - np.eye(20)).max() < 1e-12
    assert np.abs(v @ vectors.T - vectors.T * found).max() < 1e-8


def test_centred_is_exact_where_sums_are_large():
    x = np.array([[2**52 + 3], [2**52 + 10], [5]], np.int64)
    sums = x.sum(axis=0)
    assert [int(z) for z in whitening.centred(x, 3, sums)[:, 0]] == [3 * int(a) - int(sums[0]) for a in x[:, 0]]


# --- Source divergence --------------------------------------------------------------------------------------------


def brute_audit(rows, least=3, top=200):
    docs = [(t or "", lang or "", source or "") for t, lang, source in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in docs]
    within, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (_, lang, source), found in zip(docs, terms):
        within[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in within[lang].items() if n >= least)
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources} | {None: {t: sum(counts[lang, s][t] for s in sources) for t in kept}}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in own.items()}
        price = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(o, sum(price(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}]
            term = [(t, price(p[s][t], p[None][t])) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(items, 1) if part == "pair" or i <= top]
    return sorted(out)


SOME = [
    ("The cat sat; the CAT ran", "en", "a"), ("a cat and the dog", "en", "a"), ("cat the dog dog dog", "en", "b"), ("the dog é É naïve", "en", "c"), (None, "en", "d"), ("", "en", None),
    ("12 34 --", "en", "e"), ("cat cat cat", "en", "b"), ("cat cat cat", "en", "b"), ("uno", "es", "a"), ("dos", "es", "b"), (None, None, None), ("le le le la", "fr", "a"), ("le la", "fr", "a"), ("la le", "fr", None), ("É é naïve", "en", "é"), ("é", "en", "z"),
]


@pytest.mark.parametrize("small", [False, True])
def test_audit_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, and tiles of two sources
        monkeypatch.setattr(divergence, "BLOCK", 1)
        monkeypatch.setattr(divergence, "TILE", 2)
        monkeypatch.setattr(divergence, "HELD", 3)
    rows = [(i, *r, 1, 2) for i, r in enumerate(SOME)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, idx int, total int")
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs).collect())
    assert got == brute_audit(SOME)


def test_audit_of_documents_and_long_texts(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("text", "lang", "source").collect()]
    rows += [(" ".join(f"w{'abcdefghij'[i % 10]}{'klmnopq'[i % 7]}" for i in range(300_000)), "en", "src1")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs).collect())
    assert got == brute_audit(rows)


def test_audit_of_nothing_and_shares_of_large_counts(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    n, total = 7_999_999_999_999_999, 8_999_999_999_999_999
    row = spark.createDataFrame([(n, total)], "n long, total long").select(divergence.share(*[__import__("pyspark").sql.functions.col(c) for c in ("n", "total")])).first()
    assert row[0] == 1 + 10**9 * (n + 1) // total == int(divergence.shares(np.array([n]), total)[0])


# --- Quality rules ------------------------------------------------------------------------------------------------


def brute_quality(rows, most=quality_rules.MOST_TEXTS, share=quality_rules.MOST_SHARE):
    normal = lambda line: re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" "))
    texts, hosts = defaultdict(set), defaultdict(set)
    for _, text, source in rows:
        hosts[source].add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                texts[source, normal(line)].add(text or "")
    out = []
    for doc, text, source in rows:
        text = text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
        gone = sum(len(WORD.findall(x)) for x in lines if len(texts[source, normal(x)]) > max(most, share * len(hosts[source])))
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        kept = not failed and gone <= quality_rules.DEPLETED * len(words)
        out.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), gone, failed, kept))
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate_words", "base_failed", "kept"]


def own(i):
    return " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "abcdefghijkl")


def sample():
    footer = "All rights reserved by the owners of this page 20{:02d}"
    rows = [(i, f"{own(i)}\n{footer.format(i)}", "h1") for i in range(14)]
    rows += [(100 + i, f"only{i}\n{footer.format(7)}  \r\n{footer.format(9).upper()}", "h1") for i in range(3)]
    rows += [(200 + i, f"{own(500)}\n{footer.format(1)}", "h2") for i in range(20)]  # copies of one text count once
    rows += [(300, None, "h1"), (301, "", None), (302, "a b c d e f g h i", "h1"), (None, own(3), "h1"), (303, own(3), None), (303, own(3), None)]
    rows += [(304, "a b c d e " * 4 + "x", "h1"), (305, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z A B C D E F G H I J K L M N O P Q R S T U V W X Y Z", "h1")]
    rows += [(306, "é #* $ %&|<>\x0b\x0c\r a\n\n \t\na\na\na \nb c d e f g h i j k", "h3"), (307, "one\x1ftwo " * 6, "h3")]
    return rows


def test_quality_against_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, host string, row int")
    got = sorted((tuple(r[c] for c in NAMES) for r in quality_rules.quality(docs).collect()), key=repr)
    assert got == brute_quality(rows)
    assert {r[0]: r[-1] for r in got}[100] is False and {r[0]: r[-1] for r in got}[5] is True


def test_clean_takes_boilerplate_out(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in sample()], "doc_id long, text string, source string, _key string, lines int")
    out = quality_rules.clean(docs)
    assert out.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    assert left[3] == own(3) and "rights" in left[200] and not {100, 101, 300, 302} & set(left)
    assert quality_rules.clean(docs.limit(0)).count() == 0 and quality_rules.quality(docs.limit(0)).count() == 0


def test_quality_of_documents_and_long_texts(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows += [(10**9, "\n".join(f"line {i} of {i % 977} words {i * i}" for i in range(40_000)), "src1"), (10**9 + 1, "z" * 2_000_000, "src1")]
    got = sorted((tuple(r[c] for c in NAMES) for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=repr)
    assert got == brute_quality(rows)


def test_salts_split_a_hot_line(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "SALT_ROWS", 4)
    monkeypatch.setattr(quality_rules, "small", lambda df: df)
    rows = sample()
    got = sorted((tuple(r[c] for c in NAMES) for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=repr)
    assert got == brute_quality(rows)
