"""Each operator against a brute-force version on rows with nulls, ties, repeats, empty and very long texts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_words import words
from pyspark.sql import functions as F

from quillon.llm import decontamination, fingerprints, language_id, line_dedup, mixing, ngram_join, pii, token_store, toxicity, url_filters
from quillon.llm._store import Workspace
from quillon.llm._text import buffers, shingles
from quillon.llm.queries import URL_RULES, tokenizer_definition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str | None) -> set[str]:
    w = WORD.findall(small(text or ""))
    return {" ".join(w)} if 0 < len(w) < 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def test_shingles_match_strings(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows]
    got = dict(shingles(*buffers(pa.array(texts, pa.string()))))
    assert [len(got[i]) for i in range(len(texts))] == [len(shingle_set(t)) for t in texts]


def linked(sets: list[set]) -> list[int]:
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("frequent", [1 << 16, 0])
def test_jaccard_components(spark, docs, rows, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    sets = [shingle_set(r[1]) for r in rows]
    group = linked(sets)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = Counter((r[0], len(s), least[g] if s else r[0]) for r, s, g in zip(rows, sets, group))
    assert Counter(map(tuple, ngram_join.jaccard_components(spark, docs).collect())) == want


def test_jaccard_chains_and_tiles(spark, monkeypatch):
    """Slowly drifting copies link in a chain; a tile of 4 rows splits their common lists."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "SEEDS", 1)
    base = [f"t{i}" for i in range(120)]
    rows, now = [], base
    for k in range(30):
        now = [*now[: 4 * k % 116], f"n{k}", f"m{k}", *now[4 * k % 116 + 2 :]]
        rows.append((k, " ".join(now)))
    rows += [(100 + k, " ".join([*base[:60], *(f"o{k}x{i}" for i in range(60))])) for k in range(30)]
    sets = [shingle_set(t) for _, t in rows]
    group = linked(sets)
    want = {(d, len(s), min(rows[i][0] for i in range(len(rows)) if group[i] == g)) for (d, _), s, g in zip(rows, sets, group)}
    assert {tuple(r) for r in ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == want


def test_jaccard_empty_and_keep_first(spark, docs, none):
    assert ngram_join.jaccard_components(spark, none).count() == 0
    kept = ngram_join.keep_first(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.text and r.text.strip()) == [0, 0, 2, 6, 8, 9, 10]


def test_keep_first_with_repeated_and_null_ids(spark):
    """A row leaves by its own component, whatever other rows of its id do."""
    a, b, c = words(60, 200), words(61, 200), words(62, 200)
    rows = [(7, " ".join(a)), (8, " ".join([*a[:90], "x", *a[91:]])), (9, " ".join([*a[:30], "y", *a[31:]])), (3, " ".join(b)), (7, " ".join([*b[:90], "x", *b[91:]])), (None, " ".join([*b[:30], "y", *b[31:]])), (None, " ".join(c)), (None, None)]
    kept = ngram_join.keep_first(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[3], rows[6], rows[7]])


def test_url_filters(spark):
    urls = ["http://a.Example.com/en/7?x", "http://example.com/en/8", "https://notexample.com/en/", "x://net/de/8", "x://sub.example.net/de/81#a", "x://example.org/es", "x://example.org/es/", None, "", "no-scheme/en/", "://", "x://com", "x://com?/en/", "x://com/en/", "x://com/en/", "http://a..com/en/\n"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block")], "host string, path string, verdict string")

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = small(host)
        fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, rules).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert not any(x in url_filters.judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow"))


def test_url_rules_keep_host_and_path_apart(spark):
    """Rules whose paths begin in other ways than with a slash don't fit a longer host."""
    pages = spark.createDataFrame([(1, "x://a.comen/zz"), (2, "x://a.com/en"), (3, "x://b.org"), (4, "x://com#en")], "page_id int, url string")
    rules = spark.createDataFrame([("com", "en", "block"), ("org", "", "block")], "host string, path string, verdict string")
    assert {r.page_id: (r.verdict, r.rule) for r in url_filters.judge_urls(pages, rules).collect()} == {1: ("allow", None), 2: ("allow", None), 3: ("block", "org"), 4: ("allow", None)}


def test_fingerprints(spark, docs, rows, none):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for i, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (fingerprints.fingerprint(x.encode()) for x in (text, edited, after))
        want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), (a == b).mean(), (a == c).mean()] += 1
    got = fingerprints.fingerprint_documents(spark, docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == want
    assert fingerprints.fingerprint_documents(spark, none).count() == 0
    assert fingerprints.fingerprint_documents(spark, docs.limit(1)).first().near_next == 1.0


def plain_fingerprint(text: bytes) -> list[int]:
    """A second version in plain Python: all numbered k-mers sorted anew from each point of the ring."""
    mask = (1 << 64) - 1

    def mixed(x: int) -> int:
        for odd in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * odd & mask
        return x ^ x >> 33

    k = fingerprints.K
    windows = [text[i : i + k] for i in range(len(text) - k + 1)] if len(text) >= k else [text] if text else []
    hashes = [mixed(sum((b + 1) * pow(0xB492B66FBE98F273, k - i, 1 << 64) for i, b in enumerate(w)) & mask) for w in windows]
    seen: Counter = Counter()
    numbered = []
    for at, h in enumerate(hashes):
        numbered.append((h if not seen[h] else mixed((h + seen[h] * 0x9FB21C651E98DF25) & mask), at))
        seen[h] += 1
    out = []
    for point in map(int, fingerprints._POINTS):
        first = sorted(numbered, key=lambda x: ((x[0] - point) & mask, x[1]))[: fingerprints.TUPLE]
        value = 0
        for at in sorted(at for _, at in first):
            value = mixed((value * 0x9E3779B97F4A7C15 + hashes[at]) & mask)
        out.append(value >> 32)
    return out


def test_fingerprint_selects_smallest_in_text_order():
    """The ring selects what sorting all numbered k-mers from each point selects; order and repeats count."""
    r = np.random.default_rng(9)
    for text in (b"", b"a", b"short", b"abcdefgh", b"abcdefghi", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"abcabcabcabcabcabcabcabcabc" * 5, "Überstraße, größer ½".encode(), bytes(r.integers(97, 100, 500, np.uint8))):
        assert fingerprints.fingerprint(text).tolist() == plain_fingerprint(text)
    f = fingerprints.fingerprint
    assert (f(b"abcdefghij" * 3) != f(b"abcdefghij" * 4)).any()
    a, b = b"the quick brown fox jumps over it ", b"a lazy dog sleeps in the warm sun "
    assert (f(a + b) != f(b + a)).mean() > 0.2
    assert (f(a * 20) == f(a * 20)).all() and not f(b"").any()
    changed = (a + b) * 10
    assert 0.5 < (f(changed) == f(changed.replace(b"lazy", b"hazy", 1))).mean() < 1


def test_line_dedup(spark, docs, none):
    rows = [(i, "shared line\nown %d\n\nlast" % i, f"s{i % 7}") for i in range(14)] + [(20, None, "s0"), (21, "", None), (22, "shared line", None), (23, "four\nshared line", "s1"), (23, "four\nshared line", "s1")]
    rows += [(30 + i, "in four sites", f"s{i}") for i in range(4)] + [(40 + i, "in five sites", f"s{i}") for i in range(5)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, n_lines int")
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip() and s:
                sites.setdefault(line, set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= 5}
    want = Counter((d, t if t is None else "\n".join(x for x in t.split("\n") if x not in bad), 0 if t is None else len(t.split("\n")), sum(x in bad for x in (t or "").split("\n"))) for d, t, _ in rows)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark, df).collect()) == want
    assert line_dedup.dedup_lines(spark, none).count() == 0
    assert line_dedup.dedup_lines(spark, docs).count() == docs.count()


def test_toxicity(spark, docs, none):
    clean = [(i, " ".join(words(i, 60)), 0) for i in range(200)]
    toxic = [(1000 + i, " ".join([*words(5000 + i, 60), *["vilestem" + "xyz"[i % 3]] * (1 + i % 4)]), 1 + i % 2) for i in range(60)]
    train = spark.createDataFrame([(d, t, g) for d, t, g in clean + toxic], "doc_id bigint, text string, grade int")
    model = toxicity.fit(spark, train, train.union(spark.createDataFrame([(None, "x", 1), (5, "x", None)], train.schema)))
    assert (np.diff(model.thresholds) > 0).all()
    test = spark.createDataFrame([(1, " ".join([*words(9, 80), "Vilestemq!"])), (2, " ".join(words(10, 80))), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.score(spark, test, model).collect()}
    assert got[1].toxic and not any(got[i].toxic for i in (2, 3, 4)) and got[1].severity > got[2].severity >= 0
    assert sorted(r.doc_id for r in toxicity.drop_toxic(spark, test, model).collect()) == [2, 3, 4]
    assert toxicity.score(spark, docs, model).count() == docs.count() and toxicity.score(spark, none, model).count() == 0
    assert not toxicity.score(spark, test, toxicity.fit(spark, train, train.limit(0))).where("toxic").count()


def test_toxicity_scores_against_plain_version(spark):
    """Grades, severity and probabilities against sums over the features found in the strings; all grades occur."""
    from quillon.llm import _text

    def hashed(word: str, length: int | None) -> int:
        data = np.frombuffer(word.encode(), np.uint8)
        return int(_text.Words(data, np.array([0, len(data)]), _text.NON_LETTER).hashes(length)[0])

    vocabulary = ["vile", "scummy", "rotten", "awfulness", "fine"]
    weights = {hashed(w, n): x for (w, n), x in zip([(w, n) for w in vocabulary for n in toxicity.PREFIXES], np.linspace(-0.5, 2.0, 20))}
    keys = sorted(weights)
    model = toxicity.Model(np.array(keys, np.uint64), np.array([weights[k] for k in keys]), np.array([1.0, 3.0]))
    r = np.random.default_rng(2)
    texts = [(i, " ".join(r.choice([*vocabulary, "Vileness", "plain", "rot", "x"], int(r.integers(0, 6))))) for i in range(60)] + [(60, None), (61, "?!")]
    got = {x.doc_id: x for x in toxicity.score(spark, spark.createDataFrame(texts, "doc_id bigint, text string"), model).collect()}
    grades = set()
    for i, text in texts:
        found = {hashed(w, n) for w in re.findall("[a-z]+", (text or "").lower()) for n in toxicity.PREFIXES}
        reach = [1 / (1 + np.exp(t - sum(weights.get(f, 0.0) for f in found))) for t in (1.0, 3.0)]
        x = got[i]
        assert np.isclose(x.severity, sum(reach)) and np.isclose(x.p_toxic, reach[0]) and x.grade == sum(p >= 0.5 for p in reach) and x.toxic == (x.grade > 0)
        grades.add(x.grade)
    assert grades == {0, 1, 2}


def test_cumulative_link_matches_frequencies():
    """Without features the reached grades are those of the training rows."""
    grades = np.array([0] * 60 + [1] * 30 + [2] * 10)
    _, thresholds = toxicity.fit_cumulative_link([np.zeros(0, np.int32)] * 100, grades, 0)
    assert np.allclose(1 / (1 + np.exp(thresholds)), [0.4, 0.1], atol=0.01)


def test_token_store(spark, docs, rows, none):
    from tokenizers import Tokenizer

    definition = tokenizer_definition()
    tokenizer = Tokenizer.from_str(definition)
    path = Workspace(spark, "test").path("store")
    token_store.write_store(spark, docs, path, definition)
    ids = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows]
    got = token_store.read_digests(spark, path).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert Counter((r.doc_id, tuple(r.ids)) for r in token_store.read_store(spark, path).collect()) == Counter((r[0], tuple(x)) for r, x in zip(rows, ids))
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    broken = spark.read.parquet(f"{path}/recipes").withColumn("root", F.expr("cast('x' as binary)"))
    broken.write.parquet(f"{path}-broken/recipes")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{path}-broken/manifest")
    with pytest.raises(Exception, match="root"):
        token_store.verify_manifest(spark, f"{path}-broken")
    empty = Workspace(spark, "test").path("store")
    token_store.write_store(spark, none, empty, definition)
    assert token_store.read_digests(spark, empty).count() == 0


def test_tokenizer_texts_are_whole():
    definition = tokenizer_definition()
    from tokenizers import Tokenizer

    encode, plain = token_store.Encoder(definition), Tokenizer.from_str(definition)
    assert encode.by_segment
    texts = ["Don't stop,  it's 12.5% ... OK?!", "ΣΊΣΥΦΟΣ ΟΔΟΣ. İstanbul", "naïve café, E\u0301te\u0301.", "日本語 テキスト, ok", "<|endoftext|> <|startoftext|>x a<|endoftext|>", "a\u00a0b\u2003c\x0bd\x1ce", "Ünïcode—dash,,. x.y,z", "ﬁne ½ ①"]
    r = np.random.default_rng(5)
    signs = [*"aé ß.,;'s—“1٣ǅİΣςé&$%  !?ABC-", "\u00a0", "\x0b", "\x1c", "\n", "\t", "e\u0301"]
    texts += ["".join(r.choice(signs, 40)) for _ in range(1000)]
    assert [x.tolist() for x in encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets_without_harm(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "MEMO", 50)
    definition = tokenizer_definition()
    encode, plain = token_store.Encoder(definition), Tokenizer.from_str(definition)
    for k in range(12):
        texts = [" ".join(words(k % 5, 30)), " ".join(words(k, 20)) + "."]
        assert [x.tolist() for x in encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encode.memo.at) < 200
    monkeypatch.setattr(token_store, "MEMO_BYTES", 2000)
    long = ["x" * 5000 + ". " + " ".join(words(k, 20)) for k in range(4)]
    assert [encode([t])[0].tolist() for t in long] == [plain.encode(t, add_special_tokens=False).ids for t in long]


def test_other_definitions_encode_whole_texts():
    import json

    parts = json.loads(tokenizer_definition())
    for k, v in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "WhitespaceSplit"})):
        assert not token_store.Encoder(json.dumps(parts | {k: v})).by_segment


def test_pii(spark, docs, none):
    texts = ["Mail ann.lee7@site.example and ANN.Lee7@site.example, call +1 (446) 555-8962 or 446-555-8962.", "card 4111 1111 1111 1111 or 4111-1111-1111-1111, not 4111 1111 1111 1112", "10.0.0.1, 10.0.0.256, 1.2.3.4.5", "2001-02-28 28.02.2001 02/28/2001 2001-02-30", "123-45-6789 666-12-1234", "10.0.0.1", None, "", "plain words only"]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id int, text string, n_pii int")
    got = {r.doc_id: r for r in pii.pseudonymize(df, "key").collect()}
    assert [got[i].n_pii for i in range(len(texts))] == [4, 2, 1, 3, 1, 1, 0, 0, 0]
    mails = re.findall(r"\S+@site.example", got[0].text)
    assert mails[0] == mails[1].lower() and mails[0] != "ann.lee7@site.example" and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@site.example", mails[0])
    phones = re.findall(r"(\d{3})\)? ?-?(\d{3})-(\d{4})", got[0].text)
    assert phones[0] == phones[1] and re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", got[0].text)
    cards = re.findall(r"(?:\d{4}[ -]){3}\d{4}", got[1].text)
    digits = [re.sub(r"\D", "", c) for c in cards]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    assert digits[0] == digits[1] and luhn(digits[0]) and digits[0] != "4111111111111111" and cards[2] == "4111 1111 1111 1112"
    ip = got[5].text
    assert got[2].text == f"{ip}, 10.0.0.256, 1.2.3.4.5" and all(int(x) < 256 for x in ip.split("."))
    days = re.findall(r"\S+", got[3].text)
    assert days[0] == "-".join(reversed(days[1].split("."))) and days[2] == f"{days[0][5:7]}/{days[0][8:]}/{days[0][:4]}" and days[3] == "2001-02-30"
    assert re.fullmatch(r"\d{3}-\d\d-\d{4} 666-12-1234", got[4].text) and not got[4].text.startswith("123-45")
    assert got[6].text is None and got[7].text == "" and got[8].text == "plain words only"
    assert {r.text for r in pii.pseudonymize(df.where("doc_id = 5"), "other").collect()} != {ip}
    assert pii.pseudonymize(docs, "key").count() == docs.count() and pii.pseudonymize(none, "key").count() == 0


def test_pii_permutes(spark):
    """No two dates, and no two addresses of a block, share a pseudonym."""
    days = spark.range(73_000).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    out = pii.pseudonymize(days.where("hash(text) % 20 = 0"), "key")
    assert out.count() == out.distinct().count() and out.where("n_pii = 1").count() >= out.count() - 2


def test_pii_slash_dates(spark):
    """Every slash date of two years, month first and day first, with and without zeros: no two days share a pseudonym, and each keeps its form."""
    import datetime

    days = [datetime.date(y, 1, 1) + datetime.timedelta(i) for y in (1900, 2024, 2099) for i in range(366) if (datetime.date(y, 1, 1) + datetime.timedelta(i)).year == y]
    forms = {"md": "{1}/{2}/{0}", "dm": "{2}/{1}/{0}", "zmd": "{1:02}/{2:02}/{0}", "zdm": "{2:02}/{1:02}/{0}", "dots": "{2}.{1}.{0}"}
    rows = [(f, d.isoformat(), form.format(d.year, d.month, d.day)) for d in days for f, form in forms.items() if d.day > 12 or "dm" not in f]
    got = {(r.form, r.day): r.text for r in pii.pseudonymize(spark.createDataFrame(rows, "form string, day string, text string"), "key").collect()}
    for f in forms:
        new = [v for (g, _), v in got.items() if g == f]
        assert len(set(new)) == len(new)
    for (f, day), v in got.items():
        y, (a, b) = v[-4:], map(int, re.split("[/.]", v)[:2])
        if f == "zdm" and day < "2099-11-01" or f == "dm" and day < "2099-11-01":
            assert a > 12 and 1 <= b <= 12 and datetime.date(int(y), b, a)
        if f == "zmd" and day < "2099-11-13":
            assert re.fullmatch(r"\d\d/\d\d/\d{4}", v) and datetime.date(int(y), a, b)
        if f == "md" and day < "2099-11-13" and not re.match(r"\d\d/\d\d/", f"{int(day[5:7])}/{int(day[8:])}/"):
            assert "/0" not in f"/{v}"
    md, dm = {v for (f, _), v in got.items() if f == "zmd"}, {v for (f, d), v in got.items() if f == "zdm" and d < "2099-11-01"}
    assert not md & dm
    assert {got["zmd", d.isoformat()] for d in days if d.isoformat() >= "2099-11-13"} == {d.strftime("%m/%d/%Y") for d in days if d.isoformat() >= "2099-11-13"}


def test_language_id(spark, docs, none):
    vocabulary = {"en": ["the", "and", "house", "water", "with", "thing"], "de": ["der", "und", "haus", "wasser", "mit", "straße"], "ru": ["дом", "вода", "и", "с", "вещь"]}
    train = [(f"{' '.join((v * 8)[i : i + 20])}", lang) for lang, v in vocabulary.items() for i in range(6)] + [(None, "en"), ("x", None)]
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"))
    test = [(1, "the water and the house"), (2, "der haus und wasser"), (3, "вода и дом"), (4, None), (5, "12 34 !?"), (6, ""), (7, "the house with water " * 5 + "mit der straße und wasser " * 3), (None, "the")]
    df = spark.createDataFrame(test, "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "de", 3: "ru", 4: "und", 5: "und", 6: "und", 7: "en", None: "en"}
    assert all(0 <= v[1] <= 1 for v in got.values()) and got[7][1] < 1
    spans = [(r.first_word, r.end_word, r.lang) for r in language_id.spans(df.where("doc_id = 7"), model).orderBy("first_word").collect()]
    assert spans == [(0, 20, "en"), (20, 35, "de")]
    assert language_id.identify(spark, docs).count() == docs.count() and language_id.identify(spark, none).count() == 0


def test_language_id_against_plain_version(spark):
    """Whole predictions against counts, scores and paths worked out on strings."""
    from math import log

    r = np.random.default_rng(12)
    letters = {"aa": "abcdehmo", "bb": "abfghino", "cc": "абвгдежз"}
    made = lambda lang, n: ["".join(r.choice(list(letters[lang]), int(r.integers(1, 6)))) for _ in range(n)]
    train = [(" ".join(made(lang, 30)), lang) for lang in letters for _ in range(8)]
    test = [(i, " ".join([*made("aa", int(r.integers(0, 9))), "½ 12", *made("bb", int(r.integers(0, 9))), *made("cc", int(r.integers(0, 3)))])) for i in range(40)] + [(40, "½ ²"), (41, None), (42, "12 345")]
    langs = sorted(letters)

    def grams(w: str) -> list[str]:
        m = f"^{w}$"
        return [g for n in language_id.ORDERS for g in (list(w) if n == 1 else [m[i : i + n] for i in range(len(m) - n + 1)])]

    def script(w: str) -> str:
        return next((s for s, ranges in language_id.SCRIPTS.items() if any(a <= ord(w[0]) <= b for a, b in ranges)), "other")

    n, used = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for text, lang in train:
        for w in text.split():
            n[lang].update((g, len(g) if len(g) > 1 else 1) for g in grams(w))
            used[lang][script(w)] += 1
    total = {x: {o: sum(c for (_, k), c in n[x].items() if k == o) for o in language_id.ORDERS} for x in langs}

    def scores(w: str) -> list[float]:
        out = dict.fromkeys(langs, 0.0)
        for g in grams(w):
            if any((g, len(g)) in n[x] for x in langs):
                p = {x: log((n[x][g, len(g)] + 0.5) / (total[x][len(g)] + 0.5)) for x in langs}
                for x in langs:
                    out[x] += (p[x] - sum(p.values()) / len(langs)) * len(g) / sum(language_id.ORDERS)
        fits = [x for x in langs if used[x][script(w)] > 0.001 * sum(used[x].values())] or langs
        top = max(out[x] for x in fits)
        return [max(out[x] - top, -language_id.WORD_LIMIT) if x in fits else -language_id.WORD_LIMIT for x in langs]

    def predicted(text: str | None) -> tuple:
        ws = re.findall(r"[a-zа-я]+", text or "")
        if not ws:
            return "und", 0.0
        best = [(s, [k]) for k, s in enumerate(scores(ws[0]))]
        for w in ws[1:]:
            got = scores(w)
            best = [max(((s - language_id.SWITCH * (p[-1] != k) + got[k], [*p, k]) for s, p in best), key=lambda x: x[0]) for k in range(len(langs))]
        path = max(best, key=lambda x: x[0])[1]
        share = [sum(len(w) for w, k in zip(ws, path) if k == x) for x in range(len(langs))]
        return langs[int(np.argmax(share))], max(share) / sum(share)

    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"))
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.predict(spark.createDataFrame(test, "doc_id bigint, text string"), model).collect()}
    for i, text in test:
        lang, score = predicted(text)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9, (i, text, got[i], lang, score)


def test_viterbi_matches_brute_force():
    from itertools import product

    r = np.random.default_rng(5)
    at = np.array([0, 0, 6, 7, 12])
    scores = r.normal(0, 3, (12, 3)).astype(np.float32)
    path = language_id.viterbi(scores, at, 2.0)
    for a, b in zip(at, at[1:]):
        def total(p, a=a):
            return sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))

        if b > a:
            assert np.isclose(total(path[a:b]), max(total(p) for p in product(range(3), repeat=b - a)), atol=1e-4)


def test_200_languages(spark):
    r = np.random.default_rng(6)
    scores = r.normal(0, 3, (40, 200)).astype(np.float32)
    assert language_id.viterbi(scores, np.array([0, 15, 40]), 0.0).tolist() == scores.argmax(1).tolist()
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [(i, " ".join("".join(x) for x in letters[r.integers(0, 26, (12, 6))]), f"l{i:03}") for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    model = language_id.fit(df)
    assert len(model.languages) == 200
    assert {(x.doc_id, x.lang_pred) for x in language_id.predict(df, model).collect()} == {(i, lang) for i, _, lang in texts}
    assert {(x.doc_id, x.lang) for x in language_id.spans(df, model).collect()} == {(i, lang) for i, _, lang in texts}


def test_decontamination(spark, docs, none, monkeypatch):
    items = [(1, " ".join(words(70, 40))), (2, " ".join(words(71, 12))), (3, None), (4, "  "), (5, "a b c"), (1, " ".join(words(70, 40)))]
    item1 = words(70, 40)
    texts = [(1, " ".join([*words(80, 3000), *item1, *words(81, 3000)])), (2, " ".join([*words(82, 50), *item1[:20], "x", *item1[21:], *words(83, 50)])), (3, " ".join([*words(84, 50), *item1[:20]])), (4, "A b c"), (5, "a b c d"), (6, None), (None, " ".join(words(71, 12)))]
    df, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = Counter()
    for d, t in texts:
        for i, x in items:
            q, s = shingle_set(x), shingle_set(t)
            if q and 100 * len(q & s) >= 75 * len(q):
                want[d, i, len(q), len(q & s)] += 1
    assert want
    assert Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.contaminated(spark, df, bench).collect()) == want
    clean = decontamination.drop_contaminated(spark, df, bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in texts if d is not None and not any(k[0] == d for k in want))
    assert sum(1 for _ in decontamination.blocks(bench, most=10)) > 1
    monkeypatch.setattr(decontamination, "BLOCK", 10)
    assert Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.contaminated(spark, df, bench).collect()) == want
    assert decontamination.contaminated(spark, none, bench).count() == 0 == decontamination.contaminated(spark, docs, bench.limit(0)).count()


def test_decontamination_of_many_items():
    """10,000 items: everything that brute force finds is found, and a document meets few other items."""
    r = np.random.default_rng(4)
    items = [(i, np.unique(r.integers(0, 1 << 64, int(r.integers(1, 120)), np.uint64))) for i in range(10_000)]
    block = decontamination.Block(items)
    for k in range(60):
        inside = r.choice(10_000, 3, replace=False)
        parts = [items[i][1][r.random(len(items[i][1])) < share] for i, share in zip(inside, (1.0, 0.8, 0.7))]
        s = np.unique(np.concatenate([*parts, r.integers(0, 1 << 64, 400, np.uint64)]))
        want = {i: n for i in range(10_000) if 100 * (n := int(np.isin(items[i][1], s).sum())) >= 75 * len(items[i][1])} if k < 5 else {int(i): n for i in inside if 100 * (n := int(np.isin(items[i][1], s).sum())) >= 75 * len(items[i][1])}
        assert block.search(s) == want and int(inside[0]) in want
        assert len(block.candidates(s)) <= 3


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark, docs, none):
    rows = [(i, " ".join(words(i, 5 + i % 40)), f"src{i % 5}") for i in range(600)] + [(1000 + i, " ".join(words(i, 3)), "tiny") for i in range(3)] + [(2000 + i, " ".join(words(i, 20)), None) for i in range(40)] + [(7, "same row here", "src1")] * 6 + [(3000, "", "src2"), (3001, None, "src2")]
    df = spark.createDataFrame([(*r, -1) for r in rows], "doc_id bigint, text string, source string, size int")
    mixed = mixing.mix_sources(spark, df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    taken = {}
    for r in mixed:
        assert r.size == len(WORD.findall(r.text or "")) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        assert np.isclose(r.target, want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    assert len(mixed) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 30 for s in want), (taken, want)
    again = mixing.mix_sources(spark, df.repartition(3)).collect()
    assert Counter((r.doc_id, r.size, r.copies) for r in again) == Counter((r.doc_id, r.size, r.copies) for r in mixed)
    assert mixing.repeat_copies(mixing.mix_sources(spark, docs), docs.columns).columns == docs.columns
    assert mixing.mix_sources(spark, none).count() == 0 and mixing.mix_sources(spark, docs).count() == docs.count()


def test_rounding_is_unbiased(spark, monkeypatch):
    """Over 240 sources of the same twelve sizes, a long one among them, the mean copies of each size are its rate; drawn anew, sources come near their targets."""
    sizes = [1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40, 90]
    df = spark.createDataFrame([(100 * s + i, "w " * n, f"s{s:03}") for s in range(240) for i, n in enumerate(sizes)], "doc_id bigint, text string, source string")

    def off(got: list) -> float:
        taken: Counter = Counter()
        for r in got:
            assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
            taken[r.source] += r.copies * r.size
        return np.mean([abs(taken[r.source] - r.target) / r.target for r in got])

    drawn_anew = off(mixing.mix_sources(spark, df).collect())
    monkeypatch.setattr(mixing, "DRAWS", 1)
    got = mixing.mix_sources(spark, df).collect()
    assert drawn_anew < 0.03 < off(got) < 0.2
    by: dict = {}
    for r in got:
        by.setdefault((round(r.target / r.source_size, 6), r.size), []).append(r.copies)
    for (rate, _), copies in by.items():
        f = rate % 1
        assert abs(np.mean(copies) - rate) <= 4 * np.sqrt(f * (1 - f) / len(copies)) + 1e-9, (rate, np.mean(copies))


def test_mixing_folds_level_by_level(spark, monkeypatch):
    """Blocks of four over 4000 documents with long ones: taken words within the size of a short document, each 0 to 3 times."""
    monkeypatch.setattr(mixing, "BLOCK", 4)
    r = np.random.default_rng(3)
    rows = [(i, "w " * int(min(3000, r.lognormal(3, 1.2)) + 1), f"s{i % 3}") for i in range(4000)]
    mixed = mixing.mix_sources(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(mixed) == len(rows)
    taken, target = Counter(), {}
    for x in mixed:
        assert 0 <= x.copies <= 3
        taken[x.source] += x.size * x.copies
        target[x.source] = x.target
    assert all(abs(taken[s] - t) <= 60 for s, t in target.items()), (taken, target)


def test_word_count(spark, rows):
    texts = [r[1] for r in rows] + [" a", "a ", " a b ", "a\x0bb", "\u00a0", "a\nb\n", "\n", "x\u2003y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.word_count(F.col("text")).alias("n"))
    assert [r.n for r in df.collect()] == [len(WORD.findall(r.text or "")) for r in df.collect()]


def test_near_copies_that_do_not_link(spark):
    """800 texts that share most of a passage but link with none or few: what leaves the tiles is no more than their rows."""
    r = np.random.default_rng(8)
    base = words(90, 120)
    rows = []
    for k in range(800):
        own = list(base)
        for at in r.choice(24, 7 if k % 50 else 2, replace=False):
            own[5 * at] = f"n{k}x{at}"
        rows.append((k, " ".join(own)))
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = {(d, len(s), min(k for k in range(len(rows)) if group[k] == group[d])) for (d, _), s in zip(rows, sets)}
    assert len({w[2] for w in want}) > 400
    assert {tuple(x) for x in ngram_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == want


def test_line_dedup_blank_lines_and_clashing_names(spark):
    """Lines of any white space stay; 7, 8 and 20 sites; columns named like the operator's own."""
    rows = [(i, "shared\nmine %d\n\r\n\t\n \x0b" % i, f"s{i}") for i in range(9)]
    rows += [(100 * n + i, f"in {n}\nother {n} {i}", f"s{i}") for n in (4, 5, 7, 8, 20) for i in range(n)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, source string, t1 int, __q_gone2 int, h1 int")
    bad = {"shared", "in 5", "in 7", "in 8", "in 20"}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.t1) for r in line_dedup.dedup_lines(spark, df).collect()}
    assert got == {d: ("\n".join(x for x in t.split("\n") if x not in bad), t.count("\n") + 1, sum(x in bad for x in t.split("\n")), 1) for d, t, _ in rows}


def test_pii_long_tokens(spark):
    """Tokens of a megabyte neither overflow the stack nor take long."""
    n = 1 << 20
    texts = ["a@b" + ".cc" * (n // 3), "a" * n + "@b.com", "1" * n, "1 " * (n // 2), "a@" + "b" * n + ".com", "a@b" + "." * n, "(555" * (n // 4), "x@" * (n // 2), "1.2." * (n // 4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: (r.n_pii, len(r.text)) for r in pii.pseudonymize(df, "key").collect()}
    assert [got[i] for i in range(len(texts))] == [(int(i in (0, 4)), len(t)) for i, t in enumerate(texts)]


def feistel(value: int, a: int, b: int, kind: str, key: str = "key") -> int:
    x, y = divmod(value, b)
    for i in range(1, pii.ROUNDS + 1):
        m, other = (a, y) if i % 2 else (b, x)
        f = int(hashlib.sha256(f"{key}|{kind}|{i}|{m}|{other}".encode()).hexdigest()[:15], 16) % m
        x, y = ((x + f) % a, y) if i % 2 else (x, (y + f) % b)
    return x * b + y


def pseudonym(kind: str, m: str) -> str:
    """A second version, in plain Python, of the pseudonym of a valid value."""
    import datetime

    digits = re.sub(r"\D", "", m)
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        v = feistel(o[0] << 24 | o[1] << 16 | o[2] << 8 | o[3], 65536, 65536, "ip")
        return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    if kind == "date":
        first = datetime.date(1900, 1, 1)
        return (first + datetime.timedelta(feistel((datetime.date.fromisoformat(m) - first).days, 250, 292, "date"))).isoformat()
    if kind == "ssn":
        area, rest = int(digits[:3]), (int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
        v = feistel((area - (2 if area > 666 else 1)) * 989901 + rest, 898, 989901, "ssn")
        area, rest = divmod(v, 989901)
        return f"{area + (2 if area >= 665 else 1):03}-{rest // 9999 + 1:02}-{rest % 9999 + 1:04}"
    if kind == "card":
        body = digits[:-1]
        half = len(body) // 2
        new = f"{feistel(int(body), 10**half, 10 ** (len(body) - half), 'card'):0{len(body)}}"
        new += next(c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(new + c))) % 10 == 0)
    elif kind == "phone":
        ten = digits[-10:]
        v = feistel(((int(ten[:3]) - 200) * 800 + int(ten[3:6]) - 200) * 10000 + int(ten[6:]), 640000, 10000, "phone")
        new = digits[:-10] + f"{v // 8000000 + 200}{v // 10000 % 800 + 200}{v % 10000:04}"
    else:
        local, domain = m.split("@")

        def run(chars: str, alphabet: str, name: str) -> str:
            out = ""
            for at in range(0, len(chars), 12):
                part, r = chars[at : at + 12], len(alphabet)
                v = 0
                for c in part:
                    v = v * r + alphabet.index(c)
                v = feistel(v, r ** (len(part) // 2), r ** (len(part) - len(part) // 2), name)
                out += "".join(alphabet[v // r**k % r] for k in reversed(range(len(part))))
            return out

        letters = iter(run(re.sub("[^a-z]", "", local.lower()), "abcdefghijklmnopqrstuvwxyz", "letters"))
        numbers = iter(run(re.sub("[^0-9]", "", local), "0123456789", "digits"))
        return "".join(next(numbers) if c.isdigit() else (next(letters).upper() if c.isupper() else next(letters)) if c.isalpha() else c for c in local) + "@" + domain
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in m)


def test_pii_against_plain_feistel(spark):
    values = [("ip", "10.0.0.1"), ("ip", "255.255.255.255"), ("date", "2001-02-28"), ("date", "1900-01-01"), ("ssn", "123-45-6789"), ("ssn", "899-99-9999"), ("ssn", "665-01-0001"), ("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("phone", "+1 (446) 555-8962"), ("phone", "446-555-8962"), ("mail", "Ann.Lee7@site.example"), ("mail", "a_very-long.name+with99parts12345678901234@sub.site.org"), ("mail", "x@y.de")]
    df = spark.createDataFrame([(i, f"see {v}, then") for i, (_, v) in enumerate(values)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymize(df, "key").collect()}
    assert [got[i] for i in range(len(values))] == [f"see {pseudonym(k, v)}, then" for k, v in values]
