import base64
import bz2
import gzip
import hashlib
import json
import random
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.llm import langid, quality_classifier, quality_rules, secret_scan, tool_calls

SF = "/root/testdata/sf0.01"
KEY = "AKIA" + "ABCDEFGH12345678"
HEXES = "0123456789abcdef" * 2


# language ID


def test_masks_name_all_languages_of_a_gram():
    rng = np.random.default_rng(1)
    own = {name: rng.integers(1, 1 << 62, 2000, dtype=np.uint64) for name in "abc"}
    both = rng.integers(1, 1 << 62, 50, dtype=np.uint64)
    f = langid.LanguageFilter.of({"a": np.append(own["a"], both), "b": np.append(own["b"], both), "c": own["c"]})
    for bit, name in enumerate("abc"):
        assert (f.masks(own[name]) >> np.uint64(bit) & np.uint64(1)).all()
    assert ((f.masks(both) & np.uint64(3)) == 3).all()
    strange = rng.integers(1, 1 << 62, 20000, dtype=np.uint64)
    rate = (f.masks(strange) & np.uint64(1)).mean()
    assert abs(rate - f.wrong[0]) < 0.01


def test_more_languages_than_bits():
    rng = np.random.default_rng(2)
    own = {f"l{i:03}": rng.integers(1, 1 << 62, 300, dtype=np.uint64) for i in range(150)}
    f = langid.LanguageFilter.of(own)
    for n, name in enumerate(sorted(own)):
        assert (f.masks(own[name])[n // 64] >> np.uint64(n % 64) & np.uint64(1)).all()
    texts = {name: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(60)) for name in own}
    raw = {name: np.frombuffer(t.encode(), np.uint8) for name, t in texts.items()}
    learned = langid.LanguageFilter.of({name: np.concatenate([k for _, k in langid.grams(d, np.array([0, len(d)]))]) for name, d in raw.items()})
    names = sorted(raw)
    data, offsets = np.concatenate([raw[n] for n in names]), np.cumsum([0, *(len(raw[n]) for n in names)])
    assert learned.predict(data, offsets)[0] == names


def plain_grams(text):
    low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    low = re.sub(r"[\W\d_]+", " ", low)
    return Counter(low[i : i + n] for n in langid.ORDERS for i in range(len(low) - n + 1))


@pytest.mark.parametrize("window", [1 << 18, 7])
def test_grams_and_scores_equal_plain_ones(monkeypatch, window):
    monkeypatch.setattr(langid, "WINDOW", window)
    texts = ["Das  ist gut", "", "l'été, à Noël 12 !", "ab", "x", "--", "Ünï " * 9, " the the "]
    raw = [t.encode() for t in texts]
    found = list(langid.grams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    doc, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    for k, t in enumerate(texts):
        want = plain_grams(t)
        assert sorted(np.unique(keys[doc == k], return_counts=True)[1].tolist()) == sorted(want.values())
    one = langid.LanguageFilter.of({"b": keys[doc == 0], "a": keys[doc == 0], "c": keys[doc == 2]})
    names, score = one.predict(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert names[0] == "a" and names[2] == "c" and names[1] == names[5] == "und"  # a tie goes to the first in the alphabet
    assert score[0] == pytest.approx(1) and (score[1], score[5]) == (0, 0)


def test_samples_of_any_share(spark):
    from hyperloom.llm.columnar import sampled

    rows = spark.range(200_000)
    assert 800 < rows.where(sampled("id", 10**9, 2 * 10**11)).count() < 1200
    assert rows.where(sampled("id", 20_000, 5 * 10**10)).count() < 5
    assert rows.where(sampled("id", 20_000, 10_000)).count() == 200_000


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.predict_language(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and length(lang_pred) > 0")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99


def test_language_edges(spark):
    rows = [(i, "the cat and the dog were there", "en", "x") for i in range(0, 60)] + [(i, "le chat et le chien sont la", "fr", "x") for i in range(60, 120)]
    rows += [(200, None, "en", "x"), (201, "", "fr", "x"), (202, "123 !!", None, "x"), (203, "the cat " * 50000, None, "x"), (None, "le chat", None, "x"), (203, "the cat " * 50000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.learn(docs)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict_language(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, _, s in got)
    by = {k: (lang, s) for k, lang, s in got}
    assert by[200] == by[201] == by[202] == ("und", 0.0)
    assert by[203][0] == "en" and by[None][0] == "fr"
    kept = langid.keep_languages(docs, model)
    assert kept.columns == docs.columns and not {200, 201, 202} & {r["doc_id"] for r in kept.collect()}
    empty = docs.limit(0)
    assert langid.predict_language(empty, langid.learn(empty)).count() == 0
    assert langid.predict_language(docs, langid.learn(empty)).where("lang_pred <> 'und'").count() == 0


# quality rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts(spark):
    rng = random.Random(4)
    scraps = ["a", "é", "b c", "#", "\n", "\n", " ", "\t", "x y z ", "日本", "||", "\x1c", "a b c "]
    texts = ["".join(rng.choice(scraps) + rng.choice(["", " "]) for _ in range(rng.randint(0, 200))) for _ in range(150)] + [None, "", " ", "a b c a b c a b c"]
    df = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    for r in quality_rules.quality_rules(df, {}).collect():
        want = plain_counts(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"])


def test_distance():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 3.0])
    assert quality_rules.distance(a, b) == 1 and quality_rules.distance(a, 5 * a) == 0
    p, q = np.array([0.5, 0.5]), np.array([0.9, 0.1])
    m = (p + q) / 2
    assert quality_rules.distance(p, q) == pytest.approx((((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2) ** 0.5)


def test_references_are_counts_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    refs = quality_rules.references(docs)
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect() if r["lang"] and r["text"]]
    for lang, ref in refs.items():
        words = Counter(w for name, t in rows if name == lang for w in t.encode().split())
        total = sum(words.values())
        assert {w for w, n in words.items() if n * 500 >= total} == set(ref.words)
        assert [words[w] for w in ref.words] == ref.shares[:-1].tolist() and ref.shares.sum() == total
        assert ref.classes.sum() == sum(len(t) for name, t in rows if name == lang)


def test_junk_goes_and_clean_text_stays(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.quality_rules(docs, quality_rules.references(docs)).where("not base_failed").join(labels, "doc_id")
    share = {r["quality"]: r["s"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.99 and share[0] < 0.2
    assert quality_rules.keep_quality(docs, {}).columns == docs.columns
    assert quality_rules.quality_rules(docs.limit(0), {}).count() == 0


# secrets


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_matches():
    rng = random.Random(5)
    scraps = ["password", "TOKEN", "api_key", "apikey", "ſecret", "secret", "'", '"', " ", "=", ":", "abc123", "x", KEY, "AKIA", "AKIAAAA", HEXES, "f0", "é", "-", "\n"]
    for _ in range(2000):
        text = "".join(rng.choice(scraps) for _ in range(rng.randint(0, 14)))
        assert sorted(secret_scan.scan(text)) == plain_base(text)
        assert set(plain_base(text)) <= set(secret_scan.find_secrets(text)[1])


ASSIGNED = 'password = "hunter22x"'


@pytest.mark.parametrize(
    "hidden",
    [
        urllib.parse.quote(ASSIGNED),
        urllib.parse.quote(urllib.parse.quote(ASSIGNED, safe=""), safe=""),
        "".join(f"\\u{ord(c):04x}" for c in ASSIGNED),
        base64.b64encode(ASSIGNED.encode()).decode(),
        base64.urlsafe_b64encode(b"??>>" + ASSIGNED.encode()).decode().rstrip("="),
        base64.b64encode(gzip.compress(ASSIGNED.encode())).decode(),
        base64.b64encode(zlib.compress(ASSIGNED.encode())).decode(),
        base64.b64encode(urllib.parse.quote(base64.b64encode(ASSIGNED.encode()).decode()).encode()).decode(),
        "".join(f"%{b:02X}" for b in base64.b64encode(ASSIGNED.encode())),
    ],
)
def test_hidden_secrets_map_into_the_text(hidden):
    text = f"é before {hidden} after"
    base, spans = secret_scan.find_secrets(text)
    own = [(a, b) for a, kind, b in spans if kind == 0 and (a, kind, b) not in base]
    assert own and all(9 <= a < b <= 9 + len(hidden) for a, b in own)


FILLER = b"nothing to see here\n"


@pytest.mark.parametrize(
    "held",
    [
        gzip.compress(FILLER) + gzip.compress(ASSIGNED.encode()),
        gzip.compress(FILLER) + bytes(512) + gzip.compress(ASSIGNED.encode()),
        gzip.compress(FILLER + ASSIGNED[:9].encode()) + gzip.compress(ASSIGNED[9:].encode()),
        bz2.compress(FILLER) + bz2.compress(ASSIGNED.encode()),
        zlib.compress(FILLER) + zlib.compress(ASSIGNED.encode()),
        gzip.compress(gzip.compress(ASSIGNED.encode())),
        zlib.compress(bz2.compress(gzip.compress(FILLER) + gzip.compress(ASSIGNED.encode()))),
        gzip.compress(FILLER) + gzip.compress(gzip.compress(ASSIGNED.encode())),
    ],
)
def test_compressed_members_and_levels(held):
    hidden = base64.b64encode(held).decode()
    assert secret_scan.find_secrets(f"é before {hidden} after")[1] == [(9, 0, 9 + len(hidden))]


NOISE = random.Random(3).randbytes(300)
WRAPPED_TEXT = "The quick brown fox jumps over the lazy dog, " + ASSIGNED + " and runs."


@pytest.mark.parametrize(
    "hidden",
    [
        base64.encodebytes(gzip.compress(NOISE + ASSIGNED.encode())).decode(),
        base64.encodebytes(WRAPPED_TEXT.encode()).decode().replace("\n", "\r\n"),
        "data: |\n  " + base64.encodebytes(WRAPPED_TEXT.encode()).decode().replace("\n", "\n  ") + "\nend",
        "cGFzc3dvcmQg\nPSAiaHVudGVy\nMjJ4Ig==",
        "/cb/" + base64.b64encode(ASSIGNED.encode()).decode(),
        "id-7_" + base64.urlsafe_b64encode(ASSIGNED.encode()).decode(),
        "x" + base64.b64encode(b"\xff" + ASSIGNED.encode()).decode(),
        "/b/" + base64.b64encode(gzip.compress(ASSIGNED.encode())).decode(),
        base64.b64encode(ASSIGNED.encode()).decode().rstrip("=") + "A",
    ],
)
def test_base64_over_lines_and_at_all_alignments(hidden):
    text = f"é before {hidden} after"
    base, spans = secret_scan.find_secrets(text)
    assert not base and any(9 <= a < b <= 9 + len(hidden) for a, _, b in spans)
    assert secret_scan.find_secrets(secret_scan.masked(text, spans))[1] == []


@pytest.mark.parametrize("odd", ["\u00a0", "\u202f", "\u3000", "\u00ad", "\u200b", "\ufeff", "\f", "\0", "\x1b"])
def test_layers_with_odd_characters(odd):
    inner = f"{odd}{ASSIGNED} {odd}"
    for hidden in ("".join(f"%{b:02X}" for b in inner.encode()), base64.b64encode(inner.encode()).decode(), base64.b64encode(zlib.compress(inner.encode())).decode()):
        ((a, kind, b),) = secret_scan.find_secrets(f"é before {hidden} after")[1]
        assert kind == 0 and 9 <= a < b <= 9 + len(hidden)


def test_layers_with_bytes_that_are_not_utf8():
    inner = b"caf\xe9 \xff" + ASSIGNED.encode()
    run = "".join(f"%{b:02X}" for b in inner)
    assert secret_scan.find_secrets(f"x {run}")[1] == [(2 + 3 * 6, 0, 2 + 3 * (6 + len(ASSIGNED) - 1))]
    hidden = base64.b64encode(gzip.compress(inner)).decode()
    assert secret_scan.find_secrets(f"x {hidden}")[1] == [(2, 0, 2 + len(hidden))]


def test_layers_past_the_limit(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_EXPANDED", 1000)
    monkeypatch.setattr(secret_scan, "STEP", 64, raising=False)
    monkeypatch.setattr(secret_scan, "OVERLAP", 48, raising=False)
    plain = "é" * 20_000 + urllib.parse.quote(urllib.parse.quote(urllib.parse.quote(ASSIGNED, safe=""), safe=""), safe="")
    assert len(secret_scan.find_secrets(plain)[1]) == 1
    for pad in range(64):
        held = b"\xc3\xa9" * 2000 + b"x" * pad + ASSIGNED.encode() + b" more" * 500
        for made in (gzip.compress(held), bz2.compress(held), gzip.compress(held[:1500]) + gzip.compress(held[1500:])):
            hidden = base64.b64encode(made).decode()
            assert (2, 0, 2 + len(hidden)) in secret_scan.find_secrets(f"x {hidden}")[1]


def test_streams_of_any_size_and_depth():
    far = b"\xc3\xa9" * (36 << 19) + b" password = " + b"'hunter22x' " + b"\xc3\xa9" * 1000
    deep = gzip.compress(b"! " * 3000 + bz2.compress(b"? " * 10 + zlib.compress(gzip.compress(b"token: abcdefgh"))))
    for made in (gzip.compress(far), gzip.compress(b"." * (17 << 20) + gzip.compress(far)), deep, gzip.compress(b"") + deep):
        hidden = base64.b64encode(made).decode()
        base, spans, whole = secret_scan.search(f"x {hidden}")
        assert base == [] and (2, 0, 2 + len(hidden)) in spans and whole
    for escape in ("%%%02x", "\\x%02x", "\\u%04x"):
        run = "".join(escape % b for b in deep)
        assert (2, 0, 2 + len(run)) in secret_scan.find_secrets(f"x {run}")[1]


def test_a_run_longer_than_a_window_is_told(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_EXPANDED", 1000)
    hidden = base64.b64encode(zlib.compress(base64.b64encode(random.Random(1).randbytes(5000)))).decode()
    assert not secret_scan.search(hidden)[2]
    assert secret_scan.search("x " + base64.b64encode(zlib.compress(b"!" * 5000)).decode())[2]


def test_spans_over_lines_are_exact():
    text = "## cGFzc3dvcmQg\n  PSBodW50ZXIy\n  MnggYW5kIGFsc28="
    assert secret_scan.find_secrets(text)[1] == [(3, 0, text.index("MnggYW") + 3)]


def test_spans_of_escapes_are_exact():
    text = "x token%3Dabcdef1 y"
    assert secret_scan.find_secrets(text)[1] == [(2, 0, 17)]
    inner = "ab " + ASSIGNED
    text = "## " + base64.b64encode(inner.encode()).decode()
    ((a, _, b),) = secret_scan.find_secrets(text)[1]
    assert a == 3 + 3 * 4 // 3 and b <= len(text)


def test_worklist_ends():
    text = "%2525252525252525" * 50 + base64.b64encode(b"A" * 3000).decode() + "\\u005c" * 100
    assert secret_scan.find_secrets(text)[0] == []


def test_scan_and_mask(spark):
    rows = [(1, f"a {ASSIGNED} b {HEXES}", 7), (2, None, 7), (3, "", 7), (1, f"a {ASSIGNED} b {HEXES}", 7), (4, "clean " * 40000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(df).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 0, 1)
    assert got[1]["base_sha256"] == hashlib.sha256(got[1]["spans"].encode()).hexdigest()
    assert got[2]["spans"] == "" and got[4]["spans"] == ""
    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secret_scan.mask_secrets(df, "text", "n_chars").collect()}
    assert masked[1] == ('a [secret]" b [secret]', 22) and masked[2] == (None, 7) and masked[4][0] == rows[4][1]
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


# tool calls


def test_calls(spark):
    calls = spark.createDataFrame(
        [("a", None, "user", '{"turn":1,"text":"x"}'), ("b", "a", "user", '{"text":"\\u00e9\\n\\"q","turn":2}'), ("c", "b", "user", '{"turn":"2","text":"x"}'), ("d", "e", "user", '{"turn":1}'), ("e", "d", "user", "[1]"), ("f", "zz", "nope", "{}"), ("g", "e", "user", '{"turn":1,"text":"x","z":{"b":1,"a":2}}'), ("h", None, "user", "bad"), ("h", None, "user", "bad"), (None, None, None, None)],
        "id string, after string, name string, arguments string",
    ).withColumn("place", F.lit("clash"))
    results = spark.createDataFrame([("a", "zz"), ("a", "ok"), ("b", None), ("q", "w"), (None, "n")], "id string, content string")
    got = {r["id"]: r for r in tool_calls.link_calls(calls, results, tool_calls.TURN_TOOLS).collect()}
    assert {k: r["place"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": 0, "g": None, "h": None, None: None}
    errors = {"a": None, "b": None, "c": "turn: not integer", "d": "text: missing", "e": "not an object", "f": "name: unknown tool", "g": "unknown argument", "h": "id: not unique", None: "id: missing"}
    assert {k: r["error"] for k, r in got.items()} == errors
    for r in got.values():
        made = json.loads(r["message"])
        assert json.dumps(made, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["message"]
        assert ("result" in made) == r["answered"]
    assert json.loads(got["a"]["message"])["result"] == "ok" and json.loads(got["b"]["message"])["result"] == ""
    assert tool_calls.link_calls(calls.limit(0), results.limit(0), tool_calls.TURN_TOOLS).count() == 0


def test_places_of_a_long_chain(spark):
    n = 300
    calls = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(n)] + [("x", "y"), ("y", "x"), ("z", "x")], "id string, after string")
    from hyperloom.llm.shared import Tables

    got = {r["id"]: r["place"] for r in tool_calls.places(calls, Tables(spark)).collect()}
    assert got == {str(i): i for i in range(n)}


def test_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", None), (2, 0, "system", "s"), (2, 1, "user", "u"), (None, 0, "user", "n"), (3, 5, None, "r")], "conv_id long, turn long, role string, text string")
    got = {r["id"]: (r["place"], r["answered"], r["error"]) for r in tool_calls.linked_turns(turns).collect()}
    assert got == {"1/0": (0, True, None), "1/2": (1, False, "text: missing"), "2/0": (0, False, None), "2/1": (0, False, None), None: (None, False, "id: missing"), "3/5": (0, False, "name: unknown tool")}


def test_no_python_in_the_plan(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    plan = tool_calls.linked_turns(turns)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# classifier


def test_thresholds_stay_in_order_and_probabilities_fall():
    rng = np.random.default_rng(2)
    doc, slot, grade = np.repeat(np.arange(300), 3), rng.integers(0, 40, 900), rng.integers(0, 3, 300)
    grade[np.unique(doc[slot < 8])] = 2
    model = quality_classifier.OrdinalModel.fit(doc, slot, grade)
    assert model.thresholds[0] < model.thresholds[1]
    above = model.above(np.bincount(doc, model.weights[slot], 300))
    assert (above[:, 0] >= above[:, 1]).all()
    assert model.weights[:8].mean() > model.weights[8:40].mean()


def test_held_out_grades(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality_classifier.learn(docs, ratings.where("doc_id % 3 <> 1"))
    got = quality_classifier.grade_documents(docs.where("doc_id % 3 = 1"), model).join(ratings, "doc_id")
    share = {r["grade"]: r["s"] for r in got.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[2] > 0.98 and share[1] < 0.3 and share[0] < 0.1


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "word " * 60000, 0.5), (3, "word " * 60000, 0.5), (None, "x", 0.5)], "doc_id long, text string, kept double")
    ratings = spark.createDataFrame([(1, 0), (2, None), (3, 2), (None, 1)], "doc_id long, grade int")
    got = quality_classifier.grade_documents(docs, quality_classifier.learn(docs, ratings)).collect()
    assert len(got) == 5 and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    none = quality_classifier.learn(docs.limit(0), ratings.limit(0))
    assert quality_classifier.grade_documents(docs.limit(0), none).count() == 0
