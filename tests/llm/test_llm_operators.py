"""Each operator against brute force, an exact round trip, or held-out accuracy; and its edge cases."""

import hashlib
import math
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from orderlens.llm import ann, chat, components, decontam, langid, line_dedup, mixing, pii, simhash, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(data, name, spark):
    return spark.read.parquet(f"{data}/{name}.parquet")


def made(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- WARC ---------------------------------------------------------------------------------------------------------


def test_warc_round_trip_and_revisits(spark, tmp_path):
    rows = [(3, "http://a/", "same", 1), (1, "http://b/", "same", 1), (2, None, None, 1), (4, "u\r\nx: y", "é" * 300_000, 1), (None, "http://c/", "same", 1), (5, "", "", 1)]
    path = f"file://{tmp_path}/w"
    index = warc.write(made(spark, rows, "page_id long, url string, html string, digest long"), path)
    back = {r["page_id"]: r for r in warc.read(index, path).collect()}
    assert len(back) == 6 and back[1]["type"] == "response" and bytes(back[1]["body"]) == b"same"
    assert back[3]["refers_to"] == 1 and back[None]["refers_to"] == 1 and back[3]["length"] == 4
    assert back[5]["refers_to"] == 2 and bytes(back[4]["body"]) == ("é" * 300_000).encode()
    assert back[1]["digest"] == warc.digest(b"same") and len(back[1]["digest"]) == 32
    one = warc.fetch(index.where("page_id = 4"), path).collect()
    head, body = next(warc.parse(bytes(one[0]["data"])))
    assert head["WARC-Type"] == "response" and body == ("é" * 300_000).encode()
    assert {r["refers_to"] for r in warc.judge(made(spark, rows, "page_id long, url string, html string, digest long"), least=5).collect()} == {None}


def test_warc_empty(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    index = warc.write(made(spark, [], "page_id long, url string, html string"), path)
    assert warc.read(index, path).count() == 0


# --- SimHash ------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


def test_simhash_against_brute_force(spark, data):
    docs = table(data, "documents", spark)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    ids = sorted(prints)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = brute_components(ids, linked)
    assert got == {d: (f"{p:016x}", roots[d]) for d, p in prints.items()}
    # Spark's own hash is the same XXH64
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_links_random_prints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.int64).tolist()
    prints = {}
    for i in range(400):
        p = base[i % 12]
        for b in rng.integers(0, 63, rng.integers(0, 4)):
            p ^= 1 << int(b)
        prints.setdefault(p, i)
    nodes = made(spark, [(n, p) for p, n in prints.items()], "node long, fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(nodes)).collect()}
    of = {n: p for p, n in prints.items()}
    roots = brute_components(sorted(of), [(a, b) for a in of for b in of if a < b and (of[a] ^ of[b]).bit_count() <= 2])
    assert got == {n: r for n, r in roots.items() if n != r}


def test_simhash_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "", "x"), (3, "one two", "x"), (3, "one two", "x"), (4, "ONE\u000btwo", "x"), (5, "\u00a0", "x")]
    got = simhash.near_duplicates(made(spark, rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == 7
    of = {r["doc_id"]: r for r in got}
    assert of[2]["component_id"] == 1 and of[None]["component_id"] == 1 and of[4]["component_id"] == 3
    assert of[1]["fingerprint"] == "0" * 16 and of[5]["component_id"] == 5
    assert simhash.near_duplicates(made(spark, [], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        simhash.links(made(spark, [(1, 1)], "node long, fp long"), radius=1)


def test_components_of_a_long_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(None, 1), (5, 5)]
    got = {r["node"]: r["root"] for r in components.components(made(spark, rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1300)}


# --- URL filters --------------------------------------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for _, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_url_filter(spark, data):
    more = [(None, None), (-1, "no scheme"), (-2, "HTTP://M.Casino-Win.EXAMPLE.com/fr/1?x#y"), (-3, "a://b://c/d"), (-4, "x://h?q/en/"), (-5, "x://com/en/"), (-6, "http://notcom/en/"), (-7, "http://q.example.net/de/88"), (-7, "http://q.example.net/de/88")]
    pages = table(data, "pages", spark).select("page_id", "url").union(made(spark, more, "page_id long, url string"))
    got = url_filter.judge(pages.withColumn("rule", F.lit(1)), url_filter.labelled_urls(spark)).collect()
    verdicts = dict((r, v) for v, r in url_filter.RULES)
    assert len(got) == pages.count()
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == brute_rule(r["url"])
        if r["rule"]:
            assert r["verdict"] == verdicts[r["rule"]]
    of = {r["page_id"]: r for r in got}
    assert of[-2]["verdict"] == "block" and of[-1]["verdict"] == "allow" and of[None]["verdict"] == "allow"


def test_url_model_on_unseen_urls(spark):
    """Held out: no host and no path of these is in the labelled table."""
    bad_hosts = ["m.casino-win.example.org", "bets-and-casino.example.com", "pills-shop.example.net", "www.adult-loans.example.com", "jackpot-city.example.org", "buy-viagra.example.net", "porn-cams.example.com", "replica-bags.example.net"]
    good_hosts = ["blog.lantern.example.com", "books.example.org", "www.meadow.example.net", "village-news.example.com", "aquarium.example.org", "www.sailing.example.net", "poetry.example.com", "m.grammar-school.example.org"]
    bad_paths = ["/casino-win/poker-bonus/viagra-sale/xxx-adult", "/free-casino-bonus.html", "/cheap-viagra-pills", "/betting/slots-jackpot", "/adult-porn/videos", "/payday-loans-now"]
    good_paths = ["/it/1", "/reading/list.html", "/2023/11/spring-flowers", "/team", "/exhibitions/bronze-age", "/how-to/repair-a-bicycle"]
    rows = [(f"http://{h}{p}", int(h in bad_hosts or p in bad_paths)) for h in bad_hosts + good_hosts for p in bad_paths + good_paths]
    table = {r["url"] for r in url_filter.labelled_urls(spark).collect()}
    assert not table & {u for u, _ in rows}
    got = url_filter.judge(made(spark, rows, "url string, bad int"), url_filter.labelled_urls(spark)).collect()
    right = [(r["verdict"] == "block") == bool(r["bad"]) for r in got]
    print("held-out urls", sum(right), "of", len(right), [(r["url"], round(r["probability"], 2)) for r in got if (r["verdict"] == "block") != bool(r["bad"])][:9])
    assert sum(right) / len(right) >= 0.95
    of = {r["url"]: r["verdict"] for r in got}
    assert of["http://books.example.org/casino-win/poker-bonus/viagra-sale/xxx-adult"] == "block" and of["http://books.example.org/it/1"] == "allow"


def test_url_filter_edges(spark):
    assert url_filter.judge(made(spark, [], "page_id long, url string"), url_filter.labelled_urls(spark)).count() == 0
    long = "http://books.example.org/" + "a/" * 20_000
    got = url_filter.judge(made(spark, [(1, long), (1, long), (2, "")], "page_id long, url string"), url_filter.labelled_urls(spark)).collect()
    assert len(got) == 3 and {r["verdict"] for r in got} == {"allow"}


# --- PII ----------------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(c if i % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c) for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d or "0"), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii_base_against_brute_force(spark, data):
    rng = np.random.default_rng(3)
    alphabet = list("0123456789") * 3 + list("..@@+- ()aZé%\n4111") + ["😀", "255", "4111111111111111", "+1 (234) 555-6789", "a@b.c"]
    fuzz = [(10_000 + i, "".join(rng.choice(alphabet, 60))) for i in range(300)]
    more = [(20_000, None), (20_001, ""), (20_002, "7" * 3_000 + "@" + "x" * 3_000), (20_003, "a@b.c@d.e%x@y.z"), (20_004, "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4"), (None, "x@y.zz"), (None, "x@y.zz")]
    docs = table(data, "documents", spark).select("doc_id", "text").union(made(spark, fuzz + more, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.find(docs).collect())
    want = Counter()
    for r in docs.collect():
        s = brute_pii(r["text"])
        want[(r["doc_id"], hashlib.sha256(",".join(s).encode()).hexdigest(), *(sum(x.startswith(k + ":") for x in s) for k in PLAIN))] += 1
    assert got == want


def test_pii_discovers_by_context(spark):
    seeds = [(i, f"Hello. You may write to u{i}@mail.example.com today.") for i in range(20)]
    docs = seeds + [(100, "As told, write to root@localhost today."), (101, "He looked at root2@thing once."), (102, "write to jo [at] mail [dot] org"), (103, None)]
    found = {r["doc_id"]: r for r in pii.find(made(spark, docs, "doc_id long, text string")).collect()}
    assert found[100]["spans"] == "email:18:32" and found[100]["n_email"] == 0 and found[101]["spans"] == "" and found[102]["spans"] == "email:9:31"
    assert found[3]["spans"].startswith("email:24:") and found[103]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in pii.mask(made(spark, docs, "doc_id long, text string")).collect()}
    assert masked[100] == "As told, write to <email> today." and masked[101] == docs[21][1] and masked[103] is None
    assert pii.find(made(spark, [], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [30, 80, 200, 700])
def test_pii_discovery_at_any_share_of_unseen_forms(spark, n):
    """300 base mentions of each of two kinds after words of their own, n loose ones after the same words, and look-alikes after other words."""
    kinds = ("email", "phone", "ip", "card")
    seeds = [(i, f"w{i} please email x{i}@mail.example.com or call +1 ({200 + i}) 555-{1000 + i}") for i in range(300)]
    seeds += [(1000 + i, f"server at 10.0.{i % 250}.{i // 250} took card 4111 1111 1111 1111 of q{i}") for i in range(300)]
    hidden = [(10_000 + i, f"v{i} please email user{i}@host{i} or call 0{200 + i} 555 {1000 + i}") for i in range(n)]
    plain = [(50_000 + i, f"the note{i}@thing and size 0{300 + i} 555 {1000 + i} of part") for i in range(n)] + [(60_000 + i, f"see z{i} for the x{i}@y.example.org and the 10.1.{i}.1 of 2") for i in range(20)]
    rows = {r["doc_id"]: r["spans"] for r in pii.find(made(spark, seeds + hidden + plain, "doc_id long, text string")).collect()}
    for kind in kinds[:2]:
        assert sum(f"{kind}:" in rows[d] for d, _ in hidden) >= 0.9 * n, kind
    assert not any(rows[d] for d, _ in plain if d < 60_000)


# --- language ID --------------------------------------------------------------------------------------------------


def test_language_id_on_held_out(spark):
    docs = table("/root/testdata/sf0.01", "documents", spark)
    model = langid.train(docs.where(langid.learnable()), sample=150)
    got = langid.predict(docs.where(~langid.learnable()), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert model.predict(None) == ("und", 0.0) and model.predict("123 !!") == ("und", 0.0) and model.predict("") == ("und", 0.0)
    noise = model.predict("日本語のテキストです。これは学習していない言語。" * 5)
    assert noise[1] < 0.2 and model.predict("the " * 400_000)[0] == "en"


def test_language_id_edges(spark):
    docs = made(spark, [(1, "abc", None, "s", 3, 1), (None, "12", "en", "s", 2, 1)], DOCS + ", score int")
    got = langid.predict(docs, langid.train(docs.where(langid.learnable()))).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert langid.keep_known(docs).count() == 1 and langid.keep_known(docs.limit(0)).count() == 0


def test_unlearned_languages_and_junk_go(spark):
    docs = table("/root/testdata/sf0.01", "documents", spark)
    strange = [
        "日本語のテキストです。これは学習していない言語。" * 5,
        "Правительство объявило о новых мерах поддержки семей и предприятий во время кризиса.",
        "Η κυβέρνηση ανακοίνωσε νέα μέτρα για τη στήριξη των οικογενειών και των επιχειρήσεων.",
        "asdf jkl; qwer zxcv uiop hjkl asdfgh qwerty zxcvbn poiu lkjh mnbv fghj rtyu",
        "Rząd ogłosił nowe środki wspierające rodziny i przedsiębiorstwa w trudnej sytuacji gospodarczej.",
        "Hükümet, ekonomik kriz sırasında aileleri ve şirketleri desteklemek için yeni önlemler açıkladı.",
        "Hallitus ilmoitti uusista toimista, joilla tuetaan perheitä ja yrityksiä talouskriisin aikana.",
        "Il governo ha annunciato nuove misure per sostenere le famiglie e le imprese in difficoltà.",
    ]
    added = made(spark, [(-1 - i, t, None, "s", len(t)) for i, t in enumerate(strange)], DOCS)
    left = {r["doc_id"] for r in langid.keep_known(docs.unionByName(added)).collect()}
    clean = [r["doc_id"] for r in docs.where(~langid.learnable() & (F.col("text").rlike(r"\p{L}"))).collect()]
    print("unlearned left", [strange[-1 - i][:20] for i in left if i < 0], "held out left", sum(i in left for i in clean), "of", len(clean))
    assert not any(i < 0 for i in left) and sum(i in left for i in clean) >= 0.99 * len(clean)


def test_language_id_takes_little_memory_to_learn():
    rng, rows = np.random.default_rng(5), langid.SAMPLE
    at = [np.sort(rng.choice(langid.BINS, 600, replace=False)).astype(np.int32) for _ in range(rows)]
    found = pa.table({"at": pa.array(at, pa.list_(pa.int32())), "n": pa.array([rng.integers(1, 90, 600).astype(np.float32) for _ in range(rows)], pa.list_(pa.float32()))})
    tracemalloc.start()
    out = langid.described("aa", found, np.ones(langid.BINS), langid.CENTROIDS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == langid.CENTROIDS and peak < 30e6, peak  # a worker took 122 MB for such a language


def test_language_id_learns_the_same_in_any_order(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(["ab", "cd", "ef"][i % 3] for i in range(3)) + " ab cd ef" * int(n) + " cd" * int(m) for n, m in rng.integers(1, 40, (40, 2))]
    rows = [(i, t, "aa", "s", len(t)) for i, t in enumerate(texts)]
    one, other = (langid.train(made(spark, r, DOCS).coalesce(1)) for r in (rows, rows[::-1]))
    assert (one.centroids == other.centroids).all() and one.floors == other.floors


def brute_grams(text, bins):
    """Hashed counts of 1- to 3-grams of the letters, other runs as one space, by plain integers."""
    chars = [32]
    for c in [*text.lower(), " "]:
        code = ord(c) if c.isalpha() else 32
        if code != 32 or chars[-1] != 32:
            chars.append(code)
    m, out = 2**32, Counter()
    a = [x * 0x9E3779B1 % m for x in chars]
    put = lambda h: out.update([(h ^ h >> 16) & (bins - 1)])
    two = [((x ^ x >> 15) * 0x85EBCA77 + y) % m for x, y in zip(a, a[1:])]
    three = [((x ^ x >> 13) * 0xC2B2AE3D + y) % m for x, y in zip(two, a[2:])]
    for h in [*a[1:], *two, *three]:
        put(h)
    return out


def test_language_id_against_brute_force(spark, data):
    docs = table(data, "documents", spark)
    model = langid.train(docs.where(langid.learnable()), sample=60)
    bins = len(model.idf)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        v = {k: math.sqrt(n) * model.idf[k] for k, n in brute_grams(text, bins).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(got[r["doc_id"]][1] - max(0.0, cosines[best])) < 1e-4
        assert got[r["doc_id"]][0] == model.languages[best] or abs(max(c for c, l in zip(cosines, model.languages) if l == got[r["doc_id"]][0]) - cosines[best]) < 1e-4


# --- chat ---------------------------------------------------------------------------------------------------------


def brute_chat(rows):
    of = defaultdict(list)
    for c, t, r, x in rows:
        of[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in of.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark, data):
    nasty = ["<|im_end|>", "<\\|x|>", "a\\", "<|im_start|>assistant\nok<|im_end|>\n", "", None, "😀" * 50, "long " * 3000, "<<||"]
    rows = [(c, t, r, nasty[(c * 7 + t) % len(nasty)]) for c in range(-9, -1) for t, r in enumerate(["system", "user", "assistant", "tool\nx", "assistant", "us\\er", None] * 3)]
    rows += [(-20, 0, "system", "only"), (None, 1, "user", "x"), (None, None, "assistant", "y"), (-21, 1, "user", "same"), (-21, 1, "user", "same"), (-22, 3, "assistant", "b"), (-22, 3, "assistant", "a")]
    rows += [(-30, t, "assistant" if t % 2 else "user", f"turn {t} " * (t % 40)) for t in range(3000)]
    rows += [tuple(r) for r in table(data, "conversations", spark).select("conv_id", "turn", "role", "text").collect()]
    windows = chat.format_windows(made(spark, rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit(1)), budget=512, history=100)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(windows).collect()}
    assert got == brute_chat(rows)
    longest = windows.where("conv_id = -30").select(F.max(F.length("text"))).first()[0]
    repeats = windows.where("conv_id = -30 and first > 0").select((F.size(F.split("text", r"<\|im_start\|>")) - 1 - F.col("n_new")).alias("n")).agg(F.max("n")).first()[0]
    assert longest < 512 * 6 and repeats > 0
    assert chat.format_windows(made(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_windows_keep_the_budget(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi " * 60), (1, 2, "assistant", "word " * 1000), (1, 3, "user", "hi " * 60), (1, 4, "assistant", "more " * 100)]
    rows += [(2, 0, "system", "rule " * 900)] + [(2, t, "user" if t % 2 else "assistant", f"turn {t} " * 9) for t in range(1, 40)]
    rows += [(3, t, "user", "<|im_end|> <| " * (t % 50)) for t in range(200)] + [(4, 0, "user", "x " * 3000), (4, 1, "assistant", "y")]
    found = chat.format_windows(made(spark, rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "first").collect()
    most = 0
    for w in found:
        turns = chat.parse(w["text"])
        sizes = [chat.turn_tokens(*t) for t in turns]
        alone = [t for t in turns if t[0] != "system"]
        assert sum(sizes) <= chat.BUDGET or len(alone) == 1
        most = max(most, sum(sizes) * (len(alone) > 1))
    assert most > 0.75 * chat.BUDGET
    assert sum(w["n_new"] + w["system_new"] for w in found) == len(rows)
    assert all(w["text"].startswith("<|im_start|>system\nrule rule") for w in found if w["conv_id"] == 2)
    assert any(len(chat.parse(w["text"])) > w["n_new"] for w in found if w["conv_id"] == 3)


# --- nearest neighbours -------------------------------------------------------------------------------------------


def test_nearest_recall_and_scores(spark):
    rows = table("/root/testdata/sf0.1", "embeddings", spark)
    got = ann.neighbours(rows, lambda v: v % 100 == 0, group_rows=2048).collect()
    ids = np.array([r["vec_id"] for r in rows.orderBy("vec_id").collect()])
    x = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()], np.float64)
    found = defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)).tolist() if ids[i] != q][:10]
        assert sorted(found[q]) == list(range(1, 11))
        hits += len({ids[i] for i in order} & {v for v, _ in found[q].values()})
        assert all(math.isclose(s, d[ids == v][0], rel_tol=1e-12) for v, s in found[q].values())
    assert hits / (10 * len(found)) >= 0.9


@pytest.mark.parametrize("copies", [0, 2000])
def test_nearest_recall_beside_copies(spark, copies):
    real = np.array([r["embedding"] for r in table("/root/testdata/sf0.1", "embeddings", spark).collect()], np.float64)
    x = np.random.default_rng(3).multivariate_normal(real.mean(axis=0), np.cov(real.T), 4000)
    x = np.concatenate((x, np.repeat(x[:1], copies, axis=0)))
    rows = made(spark, [(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    asked = [*range(1, 4000, 80), *[0, 4000, 5999][: copies and 3]]
    found = defaultdict(list)
    for r in ann.neighbours(rows, lambda v: v.isin(asked)).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(len(x)), d)).tolist() if i != q][:10]
        assert len(found[q]) == 10 and (not copies or 0 < q < 4000 or [v for v, _ in found[q]] == want)
        hits += len(set(want) & {v for v, _ in found[q]})
    print("recall", copies, hits / (10 * len(asked)))
    assert hits / (10 * len(asked)) >= 0.9


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 2.0]), (100, [0.0, 1.0])]
    got = ann.neighbours(made(spark, rows, "vec_id long, embedding array<float>"), lambda v: v % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.neighbours(made(spark, [], "vec_id long, embedding array<float>"), lambda v: v % 100 == 0).count() == 0


def test_nearest_among_vectors_of_two_lengths(spark):
    """Each length is searched by itself, queries of the rarer one included."""
    rng = np.random.default_rng(9)
    vectors = {i: rng.standard_normal(5 if i % 10 else 3).tolist() for i in range(300)}
    found = defaultdict(list)
    for r in ann.neighbours(made(spark, [(i, v, "x") for i, v in vectors.items()], "vec_id long, embedding array<double>, v string"), lambda v: v % 50 < 2).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in [i for i in vectors if i % 50 < 2]:
        d = {i: math.dist(v, vectors[q]) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])}
        want = sorted(d, key=lambda i: (d[i], i))[:10]
        assert len(found[q]) == 10 and all(math.isclose(s, d[i], rel_tol=1e-12) for i, s in found[q])
        hits += len({i for i, _ in found[q]} & set(want))
    assert hits >= 0.9 * 10 * len(found) and len(found) == 12


# --- decontamination ----------------------------------------------------------------------------------------------


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_against_brute_force():
    rng = np.random.default_rng(1)
    jobs = [(rng.integers(1, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 40))) for _ in range(200)]
    assert decontam._align(jobs)[0].tolist() == [brute_align(a, b) for a, b in jobs]


def test_decontamination_finds_copies_and_edits(spark, data):
    items = table(data, "benchmark", spark)
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    rng = np.random.default_rng(2)
    filler = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    rows, want = [], set()
    for i, (item, text) in enumerate(list(texts.items())[:30]):
        words = text.split()
        for kind in range(3):
            now = list(words)
            if kind == 1:
                now = [("zzz" if j % 6 == 5 else w) for j, w in enumerate(now)]
            if kind == 2:
                now = [w.upper() + "!!" for j, w in enumerate(now) if j % 9 != 4]
            rows.append((1000 * kind + i, f"{filler(30)}\n{' '.join(now)} {filler(40)}"))
            want.add((1000 * kind + i, item))
    rows += [(9000 + i, filler(200)) for i in range(50)] + [(9999, None), (9998, ""), (None, texts[0])]
    docs = made(spark, rows, "doc_id long, text string").withColumn("score", F.lit(1))
    got = decontam.leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["score"] == 1 for r in got if r["doc_id"] is None or r["doc_id"] < 1000)
    blocks = decontam.leaks(docs, items, block_chars=1000).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == {(r["doc_id"], r["item_id"]) for r in got}
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, items).collect()) == [*range(9000, 9050), 9998, 9999]
    assert decontam.leaks(docs.limit(0), items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0


def test_decontamination_against_plain_search(spark, data):
    norm = lambda t: f" {' '.join(decontam.words_of(t or ''))} "
    docs, items = table(data, "documents", spark), table(data, "benchmark", spark)
    want = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if norm(i["text"]) in norm(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).where("score = 1").collect()}
    assert got == want and want


def test_decontamination_of_dense_edits_and_short_items(spark, data):
    items = table(data, "benchmark", spark).where("length(text) > 0")
    copies, want = [], set()
    for i, r in enumerate(items.orderBy("item_id").collect()):
        words = decontam.words_of(r["text"])
        for every in range(3, 7):
            now = ["zzz" if j % every == every - 1 else w for j, w in enumerate(words)]
            if brute_align(words, now) >= len(words):
                copies.append((100 * i + every, f"aside {' '.join(now)} after"))
                want.add((100 * i + every, r["item_id"]))
    beside = items.selectExpr("-1 - item_id as doc_id", "text").crossJoin(spark.range(20)).drop("id")
    edited = made(spark, copies, "doc_id long, text string")
    for docs in (edited, edited.unionByName(beside)):
        assert want <= {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    short = made(spark, [(1, "one two three"), (2, "ha ha ha ha"), (3, "single"), (4, "two words")], "item_id long, text string")
    docs = made(spark, [(1, "x one two three y"), (2, "x ha ha ha ha"), (3, "a single y"), (4, "see two words"), (5, "two other words"), (6, "one zzz three")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, short).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 1)}


def edited(rng: np.random.Generator, words: list[str], share: float) -> list[str]:
    """Words replaced, left out, and put in between."""
    out = []
    for w in words:
        kind = rng.integers(0, 4) if rng.random() < share else 3
        out += [["new"], [], [w, "new"], [w]][kind]
    return out


@pytest.mark.parametrize("min_score", [0.4, 0.5, 0.7])
def test_decontamination_finds_all_that_alignment_finds(spark, min_score):
    rng = np.random.default_rng(5)
    vocabulary, p = [f"v{x}" for x in range(300)], 1 / np.arange(1, 301)
    draw = lambda n: rng.choice(vocabulary, n, p=p / p.sum()).tolist()
    items = [(i, draw(n)) for i, n in enumerate([3, 4, 5, 6, 8, 12, 20, 33, 33, 60] * 2)]
    docs = []
    for share in (0.1, 0.3, 0.5, 0.6):
        docs += [draw(15) + edited(rng, w, share) + draw(15) for _, w in items]
    docs += [[x for w in words for x in (w, "new")] for _, words in items] + [words[: -(-len(words) // 2)] for _, words in items] + [draw(80) for _ in range(20)]
    want = {(d, i): brute_align(w, text) / (2 * len(w)) for d, text in enumerate(docs) for i, w in items}
    got = decontam.leaks(
        made(spark, [(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string"),
        made(spark, [(i, " ".join(w)) for i, w in items], "item_id long, text string"),
        min_score=min_score,
    )
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got.collect()} == {pair: s for pair, s in want.items() if s >= min_score}


def test_decontamination_of_natural_frequencies_keeps_hits_few():
    rng = np.random.default_rng(6)
    p = 1 / np.arange(1, 50_001)
    draw = lambda n: " ".join(f"w{x}" for x in rng.choice(50_000, n, p=p / p.sum()))
    rows = [(i, draw(40)) for i in range(5000)]
    texts = [draw(800) for _ in range(100)] + [" ".join([draw(50), rows[7][1], draw(50)])]
    items = decontam.Items.build(rows, 0.5)
    numbers, _ = decontam._numbered(texts, items.vocabulary)
    found = items.lookup(numbers)
    counts = sum(np.bincount(f[f >= 0], minlength=len(items.codes)) for f in found)
    hits = sum(len(at) for at, _ in decontam._hits(found, items.seeded(counts)))
    assert hits < 0.2 * len(numbers)
    assert [m[:3] for m in decontam._matches(texts, items.seeded(counts), 0.5)] == [(100, 7, 1.0)]


@pytest.mark.parametrize("hits", [1, 50])
def test_decontamination_takes_hits_in_runs_of_items(monkeypatch, hits):
    rows = [(i, f"the same words begin all of these items and number n{i} ends") for i in range(40)]
    items = decontam.Items.build(rows, 0.5)
    items = items.seeded(np.zeros(len(items.codes), np.int64))
    texts = ["nothing here", rows[3][1], None, f"{rows[5][1]} {rows[9][1]}"]
    want = decontam._matches(texts, items, 0.5)
    monkeypatch.setattr(decontam, "HITS", hits)
    assert decontam._matches(texts, items, 0.5) == want and len(want) == 80


# --- mixing -------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return out


def test_mixing_against_water_filling(spark, data):
    docs = table(data, "documents", spark).withColumn("source", F.when(F.col("source") != "src3", F.col("source"))).withColumn("target", F.lit("x"))
    docs = docs.union(made(spark, [(None, None, "en", "a", 0, ""), (-1, "", "en", "empty", 0, ""), (-2, "two words", "en", "z", 9, ""), (-2, "two words", "en", "z", 9, "")], DOCS + ", target string"))
    got = mixing.mix(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = brute_targets(sizes)
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[r["source"]]
    n = Counter(r["source"] for r in got)
    assert all(abs(taken[s] - want[s]) <= n[s] for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    out = mixing.repetitions(mixing.mix(docs)).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in out if r["n"]} == {s: n for s, n in taken.items() if n}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_fractions_reach_all_words(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(50)), "s", 50, 20) for i in range(200)]
    mixed = made(spark, rows, "doc_id long, text string, source string, size long, taken long")
    runs = {seed: {r["doc_id"]: r["text"].split() for r in mixing.repetitions(mixed, seed).collect()} for seed in ("a", "b")}
    n = Counter(w for words in runs["a"].values() for w in words)
    assert len(n) == 50 and min(n.values()) > 40 and all(len(w) == len(set(w)) == 20 for w in runs["a"].values())
    assert sum(runs["a"][i] != runs["b"][i] for i in range(200)) > 150


# --- line dedup ---------------------------------------------------------------------------------------------------


def distance_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :]


def brute_lines(rows, least):
    """Lines with a letter or digit go if they stood before, or, from `least` characters on, one edit away."""
    seen, equal, out = [], set(), {}
    for doc, text in sorted((r for r in rows if r[1] is not None)):
        kept = []
        for line in text.split("\n"):
            key = re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
            counts = re.search(r"[^\W_]", key)
            near = len(key) >= least and any(distance_one(key, s) for s in seen)
            if not counts or not (key in equal or near):
                kept.append(line)
            if counts:
                equal.add(key)
                seen += [key] * (len(key) >= least)
        out[doc] = "\n".join(kept)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcd eé"), rng.integers(4, 40))) for _ in range(25)]
    def edit(s):
        p, kind = int(rng.integers(0, len(s) + 1)), int(rng.integers(0, 4))
        c = str(rng.choice(list("abcdxé😀")))
        return [s, s[:p] + c + s[p:], s[:p] + s[p + 1 :], s[:p] + c + s[p + 1 :]][kind]
    rows = [(i, "\n".join(edit(edit(base[int(rng.integers(0, 25))])) for _ in range(rng.integers(1, 5)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "aaaaaaaaaaaaaaaaaaaa"), (204, "aaaaaaaaaaaaaaaaaaa"), (205, "abababababab\nbababababab\nbabababababa"), (206, "Item number 1\nItem number 2\nitem  number\nitem number 33"), (207, "ok\n---\n}\nOK\n---\n}\nno"), (208, "ok \nNo\n\n1")]
    docs = made(spark, rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).select("doc_id", "text")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, edit_chars=6).collect()}
    want = brute_lines(rows, 6)
    assert {d: t for d, t in got.items() if t is not None} == want and got[200] is None


def test_line_dedup_edges(spark):
    line = "A line that is long enough to count."
    rows = [(None, line), (2, line), (1, f"{line}\n{line}"), (1, f"{line}\n{line}"), (3, "x" * 5000 + "y"), (4, "x" * 5000 + "z")]
    got = line_dedup.dedup_lines(made(spark, rows, "doc_id long, text string")).collect()
    texts = sorted((str(r["doc_id"]), r["text"], r["n_dropped"]) for r in got)
    assert texts == [("1", line, 1), ("1", line, 1), ("2", "", 1), ("3", "x" * 5000 + "y", 0), ("4", "", 1), ("None", "", 1)]
    assert line_dedup.dedup_lines(made(spark, rows, "doc_id long, text string"), edits=0).where("doc_id = 4").first()["n_dropped"] == 0
    assert line_dedup.dedup_lines(made(spark, [], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(made(spark, rows, "doc_id long, text string"), edits=2)


# --- very long texts and clashing columns ---------------------------------------------------------------------------


def test_very_long_texts(spark, data):
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 50_000, 120_000)]
    item = table(data, "benchmark", spark).where("length(text) > 0").orderBy("item_id").first()
    text = " ".join([*words[:90_000], item["text"], *words[90_000:]])
    docs = made(spark, [(1, text, "en", "s", len(text)), (2, "short one", "en", "s", 9)], DOCS)
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs).collect()}[1] == f"{brute_fingerprint(text):016x}"
    got = decontam.leaks(docs, table(data, "benchmark", spark)).where(f"item_id = {item['item_id']}").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, 1.0)] and got[0]["first_word"] == 90_000
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: len(text.split()), 2: 2}
    assert line_dedup.dedup_lines(docs).where("doc_id = 1").first()["text"] == text


def test_personal_data_of_a_text_of_very_many_mentions(spark):
    n = 20_000
    text = "".join(f"u{i}@h.example, 01234 56{i:05d}\n" for i in range(n))
    start = time.monotonic()
    got = pii.find(made(spark, [(1, text)], "doc_id long, text string")).first()
    assert got["n_email"] == n and got["base_sha256"] == hashlib.sha256(",".join(brute_pii(text)).encode()).hexdigest()
    masked = pii.mask(made(spark, [(1, text)], "doc_id long, text string")).first()["text"]
    assert masked.count("<email>") == n and "@" not in masked
    print("seconds for 20,000 mentions", round(time.monotonic() - start, 1))
    assert time.monotonic() - start < 120


def test_columns_that_clash_with_the_operators_own(spark):
    rows = made(spark, [(i, [float(i), 1.0], "x") for i in range(1, 30)], "vec_id long, embedding array<double>, ids string")
    for name in ("v", "p", "group", "salt", "score", "rank", "query_id", "n", "d"):
        rows = rows.withColumn(name, F.lit("own"))
    assert ann.neighbours(rows, lambda v: v == 7).orderBy("rank").first()["vec_id"] in (6, 8)
    docs = made(spark, [(1, "mail a@b.example")], "doc_id long, text string")
    for name in ("t", "rid", "marks", "kind", "s", "e", "base", "inst", "ctx", "spans", "every", "row", "fp", "line", "h"):
        docs = docs.withColumn(name, F.lit("own"))
    assert pii.find(docs).first()["spans"] == "email:5:16" and pii.mask(docs).columns == docs.columns
    assert simhash.near_duplicates(docs).count() == 1 and simhash.dedup(docs).columns == docs.columns
    pages = made(spark, [(1, "http://a/", "x")], "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("salt", F.lit(2)).withColumn("first", F.lit(3))
    assert warc.judge(pages).count() == 1
    turns = made(spark, [(1, 1, "user", "x")], "conv_id long, turn long, role string, text string").withColumn("i", F.lit("o")).withColumn("k", F.lit("o")).withColumn("part", F.lit("o"))
    assert chat.format_windows(turns).count() == 1


def test_dedup_goes_by_rows(spark):
    rows = [(3, "A x y"), (5, "A x y"), (5, "B q z"), (None, "A x y")]
    left = simhash.dedup(made(spark, rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left))) == ["(3, 'A x y')", "(5, 'B q z')", "(None, 'A x y')"]


def test_shared_folder_and_broadcasts(spark):
    from orderlens.llm import common

    class Cluster:
        conf, sparkContext = type("conf", (), {"get": staticmethod(lambda *a: None)}), type("sc", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
    wide = common.stage(made(spark, [(1, "x" * 1000)] * 50, "a long, b string"), "wide")
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(common.small(wide)) and "broadcast" not in plan(common.small(wide, size=10_000)) and "broadcast" not in plan(common.small(wide, rows=10))
    path = common._paths[wide]
    common.unstage(wide)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
