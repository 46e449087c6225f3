"""Personal data, decontamination, packing, toxicity, url templates and sharding against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bytehash, decontaminate, fmindex, packing, pii, sharding, toxicity, urlfilter
from tidewatch.llm.common import components, numbered

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


PII_TEXTS = [
    None, "", "a@b.c@d.e x_y@z.w q@", "mail é𝄞 to x.y+z@ä.com or a@b-c.de.", "a@b.c" * 30, "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.00001", "card 4539 1488 0343 6467 and 4539148803436468",
    "+1 (415) 555-0100, +1-2 +12345678901234567890 +4912345678.", "9" * 300, "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013001", "my ssn 219-09-9999 and 219-09-9999x; no context here at all, nothing, nothing, nothing 219-09-9998",
    "x" * 50_000 + "@" + "y" * 50_000 + ".z", "1.1.1.1 " * 500,
]


def test_base_spans_equal_python(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("ab@.-+ 0123456789()") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts = PII_TEXTS + noise
    for r in pii.digest(docs(spark, texts)).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r.doc_id], r.spans, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]


def test_added_kinds_and_redaction(spark):
    found = {r.doc_id: [s.kind for s in r.pii] for r in pii.find(docs(spark, PII_TEXTS)).collect()}
    assert "iban" in found[9] and found[9].count("iban") == 1
    assert found[10].count("national_id") == 1
    text = {r.doc_id: r.text for r in pii.redact(docs(spark, PII_TEXTS)).collect()}
    assert text[0] is None and text[1] == "" and text[3] == "mail é𝄞 to x.y+z@ä.com or <EMAIL>."
    assert "<IBAN> or" in text[9]
    clash = docs(spark, ["a@b.cd"]).withColumn("pii", F.lit(1))
    assert pii.find(clash).first().pii[0].end == 6
    assert pii.digest(docs(spark, [])).count() == 0


def hits(text, items):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hit, ids = set(), set()
    for item, t in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(13, len(iw))
        for j in range(max(0, len(iw) - 12) or (1 if iw else 0)):
            for i in range(len(ws) - k + 1):
                if ws[i : i + k] == iw[j : j + k]:
                    hit |= set(range(i, i + k))
                    ids.add(str(item))
    return len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontamination_equals_scan(spark, monkeypatch, blocks):
    rng = random.Random(5)
    vocabulary = ["ab", "Ab", "c", "d", "é", "7"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(25)] + [(98, None), (99, " . "), (100, "unseen words")]
    items.append((3, items[3][1]))
    texts = [None, "", "...", items[0][1]] + ["; ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["x " * 4000 + items[7][1] + " y" * 4000]
    monkeypatch.setattr(decontaminate, "SHARD", 200)
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2 * sum(len(t or "") for _, t in items) // blocks)
    got = decontaminate.digest(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == hits(texts[r.doc_id], items), texts[r.doc_id]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs(spark, texts), none).count() == len(texts)
    assert decontaminate.digest(docs(spark, []), none).count() == 0


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontamination_judges_each_row(spark, monkeypatch, blocks):
    items = [(1, "a b c d"), (2, "e f g"), (None, "h i"), (None, "j k")]
    texts = ["a b c d", "x y", "e f g", "h i j k", "a b c d e f g", "x", "x y"]
    ids = [None, None, 5, 5, 5, 5, 7]
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2 * sum(len(t) for _, t in items) // blocks)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(docs(spark, texts, ids), table).select("doc_id", "n_words", "n_hit", "n_items").collect()
    want = [(None, 4, 4, 1), (None, 2, 0, 0), (5, 3, 3, 1), (5, 4, 4, 1), (5, 7, 7, 2), (5, 1, 0, 0), (7, 2, 0, 0)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = decontaminate.clean(docs(spark, texts, ids), table).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", "x"), ("7", "x y"), ("None", "x y")]


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 4, 500)
    index = fmindex.Index(s)
    for k in (1, 3, 6):
        phrase = s[100 : 100 + k]
        table = np.zeros((1, 6), np.int64)
        table[0, 6 - k :] = phrase
        lo, hi = index.search(table, np.array([k]))
        want = [i for i in range(500 - k + 1) if (s[i : i + k] == phrase).all()]
        assert sorted(index.locate(np.arange(lo[0], hi[0]))) == want


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted(rng.sample(range(0, 40), 7))
        counts = [rng.randint(1, 9) for _ in lengths]
        for k in (1, 2, 3, 9):
            best = min(padding(lengths, counts, c) for size in range(1, k + 1) for c in itertools.combinations(lengths, min(size, 7)) if c[-1] == lengths[-1])
            got = packing.boundaries(np.array(lengths), np.array(counts), k)
            assert len(got) <= k and padding(lengths, counts, got) == best
    assert packing.boundaries(np.array([]), np.array([]), 4) == []


def test_packing_keeps_all_tokens_within_budget(spark):
    texts = [None, ""] + ["w " * n for n in (1, 2, 3, 5, 8, 13, 100, 1000)] * 3
    rows = packing.packed(docs(spark, texts), longest=64, buckets=4, budget=128).collect()
    assert sum(r.length for r in rows) == sum((t or "").count("w") for t in texts)
    assert all(r.length <= r.bound <= 64 for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.bound, r.batch), []).append(r.slot)
    full = {}
    for (b, bound, k), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) * bound <= 128 or len(slots) == 1)
        full.setdefault(b, []).append((k, len(slots), bound))
    for ks in full.values():
        ks.sort()
        assert [k for k, _, _ in ks] == list(range(len(ks)))
        assert all(n == max(1, 128 // max(1, bound)) for _, n, bound in ks[:-1])
    assert packing.packed(docs(spark, [])).count() == 0


def test_toxicity_learns_words_and_ignores_held_out_labels(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(max(1, len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(["slur", "scold", "Jeer"])
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    texts += [None, "", "slur"]
    d = docs(spark, texts)
    table = spark.createDataFrame(labels + [(7, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(d, table).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i, _ in labels)
    right = sum(got[i].predicted == labels[i][1] for i in held) / len(held)
    assert right > 0.95 and got[1502].predicted == 1 and got[1501].predicted == 0
    turned = spark.createDataFrame([(i, 1 - y if i in set(held) else y) for i, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.digest(d, turned).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)
    assert {r.score for r in toxicity.digest(docs(spark, ["a"]), spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0.0}


def test_toxicity_knows_rare_words_of_a_large_corpus(spark, monkeypatch):
    rng = random.Random(9)
    # 1.5 million pairs of document and word: a share of 1 / 2 ** 18 of them is six documents, and the rare word stands in five
    texts = [" ".join(f"w{j}" for j in rng.sample(range(3000), 1000)) for _ in range(1500)]
    labels = [(i, int(i % 10 == 0)) for i in range(300)]
    ids = [i for i, y in labels if y and zlib.crc32(str(i).encode()) % 5 > 1]
    for i, y in labels:
        if y:
            texts[i] = " ".join(f"w{rng.randrange(3000)} slur" for _ in range(30))
    for i in ids[:3]:
        texts[i] = " ".join(f"w{rng.randrange(3000)} seldom" for _ in range(30))
    texts += ["w1 seldom w2", "w1 unseen w2", "w1 seldom w2"]
    d, table = docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.digest(d, table).collect()}
    assert len(got) == len(texts) and got[1500] > got[1501] + 0.1 and got[1500] == got[1502]
    monkeypatch.setattr(toxicity, "HOT_KEYS", 0)
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    again = {r.doc_id: r.score for r in toxicity.digest(d, table).collect()}
    assert all(abs(again[i] - got[i]) < 1e-9 for i in got)


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_rules_and_templates(spark):
    urls = [None, "", "no host", "http://", "HTTP://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://notexample.org/en/12", "http://org/a", "http://org", "http://x.com#a", "http://É.com/fr/é", "http://x.com/de/1/2/3/4/5/6\n", "ftp://u://x.org/"]
    urls += [f"http://shop.com/de/{i}" for i in range(60)] + [f"http://shop.com/fr/{i}" for i in range(60)] + [f"http://shop.com/en/{i}" for i in range(60)] + ["http://shop.com/en/1"] * 2
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, verdict int")
    rows = urlfilter.judged(pages, RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = split(urls[r.page_id])
        fits = [x for x in RULES if (host == x[1].split("/", 1)[0] or host.endswith("." + x[1].split("/", 1)[0])) and path.startswith("/" + x[1].split("/", 1)[1])]
        rule = max(fits, key=lambda x: len(x[1])) if fits else None
        assert (r.host, r.path, r.rule) == (host, path, rule[1] if rule else None)
        assert r.verdict == rule[0] if rule else r.verdict in ("allow", "block")
    shop = {r.path.split("/")[1]: (r.template, r.purity) for r in rows if r.host == "shop.com"}
    assert shop["de"][0] == "/de/*" and shop["de"][1] > 0.6 > shop["fr"][1]
    assert urlfilter.judged(pages.limit(0), RULES).count() == 0


def test_shards_are_even_and_keep_groups(spark):
    texts = [None, ""] + [f"t{i}" for i in range(300)] + ["copy"] * 250 + [f"pair{i // 2}" for i in range(100)]
    rows = sharding.sharded(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    counts = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    shard = {r.doc_id: r.shard for r in rows}
    assert all(shard[i] == shard[i + 1] for i in range(552, 652, 2))
    assert len({shard[i] for i in range(302, 552)}) == 4
    assert sharding.sharded(docs(spark, [])).count() == 0


def test_numbering_and_components(spark, monkeypatch):
    monkeypatch.setattr("tidewatch.llm.common.CELL_ROWS", 7)
    rows = numbered(spark.range(100).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3)), ["g"], ["id"], "at", 100).collect()
    for g in (None, 1, 2):
        assert sorted(r["at"] for r in rows if r["g"] == g) == list(range(sum(r["g"] == g for r in rows)))
    chain = [(i, i + 1) for i in range(40)] + [(60, 50), (50, 55), (55, 60), (7, 7)]
    nodes = spark.range(70).select("id")
    got = {r.id: r.component for r in components(nodes, spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 40 else 50 if i in (50, 55, 60) else i for i in range(70)}


def test_word_hashes_follow_words():
    text = "Ab ab, ÀÉ x1-2 \u0000 ab"
    words = bytehash.words(text)
    assert words == ["ab".encode(), "ab".encode(), "ÀÉ".encode(), b"x1", b"2", b"ab"]
    h = bytehash.word_hashes(text)
    assert h[0] == h[1] == h[5] and len(set(h.tolist())) == 4
