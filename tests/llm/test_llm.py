"""The ten operators and the pipeline against brute force, exact round trips and held-out accuracy, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ferrule.llm import chat, decontamination, embedding_dedup, licenses, mixing, pii, quality, simhash, token_counts, toxicity
from ferrule.llm.common import components, running_total, table

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort über alles " * 9000
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (4, LONG, "de", "b", 1), (5, LONG, "de", None, 1), (None, "one two", "en", "b", 7), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names operators use inside."""
    extra = ["id", "key", "digest", "fp", "rep", "size", "target", "row", "hit", "items", "word", "t", "c", "base", "g"]
    df = spark.createDataFrame(ODD, DOCS)
    return df.select("*", *[F.lit("x").alias(c) for c in extra]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def classes(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)] + [(0, 900 + i) for i in range(200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if any(n in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_total(spark):
    got = running_total(spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k long, v long"), "k", "v").orderBy("k").collect()
    assert [r.total for r in got] == np.concatenate([[0], np.cumsum([r.v for r in got])[:-1]]).tolist()


# 1


def test_token_counts_match_the_library(spark, docs, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    rng = random.Random(1)
    alphabet = [*"ab'sS tl 1²½\n\t\r\x0b\x0c\x1c\x85\xa0éßΩж中あ한　—“😀́_-", "<|endoftext|>", "'ll", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    count = token_counts.counter(open(BPE, encoding="utf-8").read(), token_counts.frequent_lengths(open(BPE, encoding="utf-8").read()), cache=50)
    texts += [" ".join(rng.choice(["中文 字", "word", "\u3000 x", "한국어", "\u1c80\u1c81", "नमस्ते", "it's", "\x1c", "😀😀", "\n\n", "12", "𞤀𞤁"]) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    assert [count(t.encode()) for t in texts] == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    for df in (docs, odd):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, BPE).collect()) == want
    assert token_counts.count_tokens(none, BPE).count() == 0
    tier = token_counts.sampled_lengths(docs, open(BPE, encoding="utf-8").read(), "text", 100)
    assert tier and max(tier.values()) > 1 and all(n == len(tok.encode(w, add_special_tokens=False).ids) for w, n in tier.items())
    over = {r.doc_id: r.over_limit for r in token_counts.op1_token_counts(spark, SF).collect()}
    assert over == {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) > 512 for r in docs.collect()}


# 2


def test_quality_keeps_good_and_rejects_bad(spark, docs):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    got = {r.doc_id: r.selected for r in quality.op2_quality(spark, SF).collect()}
    good = [got[i] for i, q in labels.items() if q]
    bad = [got[i] for i, q in labels.items() if not q]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_quality_draw_beside_the_filter(spark, docs):
    labels = table(spark, SF, "labels")
    rows = quality.op2_quality(spark, SF).collect()
    _, least, weighed = quality.resample(docs, labels)
    assert {(r.doc_id, r.draw_key, r.drawn) for r in rows} == {(r.doc_id, r.sample_key, r.sample_key >= least) for r in weighed.collect()}
    assert sum(r.drawn for r in rows) == quality.sample_size(docs, labels) < len(rows)


def test_quality_sample_is_the_k_largest_keys(spark, docs):
    for tempered in (False, True):
        _, least, weighed = quality.resample(docs, table(spark, SF, "labels"), k=37, tempered=tempered)
        rows = weighed.collect()
        assert least == sorted((r.sample_key for r in rows), reverse=True)[36]
        assert weighed.where(quality.selected(least)).count() == 37
        for r in rows[:20]:
            u = (int(xxhash64_signed(str(r.doc_id)) % 2**64 >> 11) + 0.5) / 2**53
            assert r.sample_key == pytest.approx((r.tempered / quality.TEMPERATURE if tempered else r.log_weight) - np.log(-np.log(u)))


def test_quality_inclusion_follows_the_weights(spark):
    """Over many draws a document is the first of the sample as often as its share of all target over raw probabilities says, and the first two likewise."""
    weights, draws = [0.0, -1.0, 0.7, 0.3, -2.0], 6000
    n = len(weights)
    df = spark.range(n * draws).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, weights)), (F.col("id") % n + 1).cast("int")).alias("log_weight"), F.lit(9.0).alias("tempered"))
    p = np.exp(weights) / np.exp(weights).sum()
    for seed in (quality.SEED, 77):
        keys = np.array([r.key for r in df.select("doc_id", quality.sample_key(False, "doc_id", seed).alias("key")).orderBy("doc_id").collect()]).reshape(draws, n).T
        first = np.bincount(keys.argmax(0), minlength=n) / draws
        assert np.abs(first - p).max() < 0.02
        two = [p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(n) if j != i) for i in range(n)]
        among = np.bincount(np.argsort(keys, 0)[-2:].ravel(), minlength=n) / draws
        assert np.abs(among - two).max() < 0.02


def test_quality_size_of_the_sample_is_the_share_of_good_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(10)] + [(3, "word3 and more")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 1), (2, 0), (3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    _, least, weighed = quality.resample(docs, labels)
    assert weighed.where(quality.selected(least)).count() in (6, 7)  # half of eleven; the repeated row may tie with the last
    assert least == sorted((r.sample_key for r in weighed.collect()), reverse=True)[5]


def xxhash64_signed(text, seed=42):
    h = xxhash.xxh64(text.encode(), seed=seed).intdigest()
    return xxhash.xxh64((quality.SEED & 0xFFFFFFFF).to_bytes(4, "little"), seed=h).intdigest()


def test_quality_weights_are_sums_of_log_ratios(spark, docs):
    labels = table(spark, SF, "labels")
    ratios = quality.log_ratios(docs, labels)
    good = {r.doc_id for r in labels.collect() if r.quality}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for r in docs.collect():
        c = np.bincount(quality.ngrams(r.text.encode()), minlength=quality.BUCKETS)
        raw += c
        target += c * (r.doc_id in good)
    p = (raw + 1) / (raw.sum() + quality.BUCKETS)
    assert np.allclose(ratios, np.log((target + quality.BUCKETS * p) / (target.sum() + quality.BUCKETS)) - np.log(p))


def test_quality_weight_of_each_document(spark, docs):
    """Each document's weight and tempered weight, n-gram by n-gram, and the sample of a size asked for."""
    labels = table(spark, SF, "labels")
    ratios, _, weighed = quality.resample(docs, labels, k=50)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in weighed.collect()[:60]:
        tokens = re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20\x7f]+", text[r.doc_id].encode().lower())
        crc = [zlib.crc32(t) for t in tokens]
        grams = crc + [1 if a == b else (a * 0xD6E8FEB86659FD93 + b * 0x9E3779B97F4A7C15) % 2**64 for a, b in zip(crc, crc[1:], strict=False)]
        w = [ratios[(g * 0x9E3779B97F4A7C15 % 2**64) >> 50] for g in grams]
        assert r.log_weight == pytest.approx(sum(w), abs=1e-6)
        assert r.tempered == pytest.approx(sum(w) / max(1, len(w)) * min(len(w), quality.EVIDENCE) ** 0.5, abs=1e-6)
    assert quality.keep_sample(docs, labels, k=50).count() == 50


def test_quality_held_out(spark):
    """Learnt without a fifth of the labels, the sample still tells that fifth apart."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    _, least, weighed = quality.resample(docs, labels.where(~toxicity.held_out("doc_id")), tempered=True)
    got = {r.doc_id: r.sample_key >= least for r in weighed.collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.where(toxicity.held_out("doc_id")).collect()]
    assert np.mean([g for g, q in held if q]) > 0.95 and np.mean([g for g, q in held if not q]) < 0.15


def test_quality_on_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 1), (2, None), (None, 1), (4, 0)], "doc_id long, quality int")
    kept = quality.keep_sample(odd, labels)
    assert kept.columns == odd.columns
    assert kept.count() <= len(ODD)
    assert quality.keep_sample(odd, labels.limit(0)).count() == len(ODD)
    assert quality.keep_sample(none, labels).count() == 0
    assert quality.keep_sample(odd, labels.where("quality = 0")).count() == 0
    assert quality.keep_sample(odd, labels, tempered=True).columns == odd.columns
    assert quality.keep_sample(odd, labels.limit(0), tempered=True).count() == len(ODD)


# 3


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len("".join(chat.parts(r, t))) for r, t in turns))
    return out


CHATS = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c"), (2, 2, "user", "\\<s>\\\\</s>[INST]"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, None, None, None), (4, 0, "assistant", "x" * 20000), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user\nassistant", "a"), (None, 1, "assistant", "<|endoftext|>\n</s>\n"), (6, 0, "user", "a"), (6, 1, "assistant", "c"), (6, 2, "user", "q"), (7, 0, "user", "a"), (7, 1, "assistant", "b"), (7, 2, "user", "r")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("node", F.lit("x"))
    segments, members = chat.pack(df, BPE)
    got = {r[0]: tuple(r)[1:6] for r in chat.read_back(segments, members, BPE).collect()}
    assert got == brute_chat(CHATS)
    nothing = chat.pack(df.limit(0), BPE)
    assert nothing[0].count() == 0 and chat.read_back(*nothing, BPE).count() == 0
    for text in ("\\", "\\\\<s>", "[INST]</s>\\n", "<</s>>", "\\n\n"):
        assert chat.unescape(chat.escape(text)) == text
        assert chat.read_turn("".join(chat.parts(text, text))) == (text, text)
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_chat_stream_holds_each_conversation_as_its_intervals(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    segments, members = chat.pack(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string"), BPE)
    nodes = sorted(segments.collect(), key=lambda r: r.offset)
    stream = [i for n in nodes for i in n.ids]
    assert [n.offset for n in nodes] == np.cumsum([0] + [n.n_tokens for n in nodes[:-1]]).tolist()
    by_node = {bytes(n.node): n for n in nodes}
    assert len(by_node) == len(nodes) < len(CHATS)
    last, parent = {}, {}
    for m in sorted(members.collect(), key=lambda m: (m.conv, m.k)):
        n = by_node[bytes(m.node)]
        up = last.get(m.conv)
        # The ancestors' intervals are the tokens of all turns before, and positions count them.
        before = [i for a in n.ancestors for i in stream[a.start : a.end]]
        assert len(before) == n.position and before == ([] if up is None else [i for a in up.ancestors for i in stream[a.start : a.end]] + list(up.ids))
        parent[bytes(m.node)] = up and bytes(up.node)
        last[m.conv] = n
    # Depth first: the subtree of a node is one stretch of the stream.
    order = [bytes(n.node) for n in nodes]
    for x in order:
        inside = [i for i, y in enumerate(order) if x in ancestors(y, parent)]
        assert inside == list(range(inside[0], inside[0] + len(inside)))
    assert tok.decode(stream[:3], skip_special_tokens=False)


def ancestors(node, parent):
    out = []
    while node is not None:
        out.append(node)
        node = parent[node]
    return out


# 4


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = {r.doc_id: r for r in toxicity.op4_toxicity(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[i].score, y) for i, y in labels.items() if rows[i].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in held for b, z in held if y > z]
    assert np.mean(pairs) > 0.85


def test_toxicity_scores_by_hand(spark):
    """Log-count ratios, the features they pick and every score, from the n-grams of each text."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    which, weight, base = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    y = {i: t for i, t in y.items() if i in text}
    n = {0: sum(not t for t in y.values()), 1: sum(map(bool, y.values()))}
    seen = {0: defaultdict(int), 1: defaultdict(int)}
    for i, t in y.items():
        for b in toxicity.buckets(text[i]).tolist():
            seen[int(t > 0)][b] += 1
    ratio = {b: np.log((seen[1][b] + 1) / (n[1] + 2)) - np.log((seen[0][b] + 1) / (n[0] + 2)) for b in set(seen[0]) | set(seen[1]) if seen[0][b] + seen[1][b] >= toxicity.LEAST}
    gain = {b: abs(r) * abs(seen[1][b] / n[1] - seen[0][b] / n[0]) for b, r in ratio.items()}
    least = sorted(gain.values(), reverse=True)[min(toxicity.FEATURES, len(gain)) - 1]
    assert len(which) == min(toxicity.FEATURES, len(gain)) and all(gain[b] >= least - 1e-12 for b in which.tolist())
    # The regression: coefficients over the ratios are where the penalised loss has no slope.
    at = {b: k for k, b in enumerate(which.tolist())}
    w = weight / np.array([ratio[b] for b in which.tolist()])
    x = np.zeros((len(y), len(which)))
    for row, i in enumerate(y):
        for b in toxicity.buckets(text[i]).tolist():
            if b in at:
                x[row, at[b]] = ratio[b]
    e = 1 / (1 + np.exp(-(x @ w + base))) - np.array([t > 0 for t in y.values()])
    slope = x.T @ e / len(y) + 2e-2 * w / len(which) ** 0.5
    assert np.abs(slope).max() < 0.02 and abs(e.mean()) < 0.02
    for r in toxicity.score(docs, (which, weight, base)).collect()[:50]:
        z = base + sum(weight[at[b]] for b in set(toxicity.buckets(text[r.doc_id]).tolist()) if b in at)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))


def test_toxicity_on_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd, toxicity.fit(odd, labels, "doc_id", "text", "toxic")).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, toxicity.fit(none, labels, "doc_id", "text", "toxic")).count() == 0
    grams = {t[i : i + n] for t in [" ab cd "] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}
    assert len(toxicity.buckets("AB cd")) == len(grams)


# 5


def brute_hits(text, bench):
    ws = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    hit, items = set(), set()
    for item, t in bench:
        iw = words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        m = min(13, len(iw))
        for w in {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if m else ():
            for i in range(len(ws) - m + 1):
                if tuple(ws[i : i + m]) == w:
                    hit |= set(range(i, i + m))
                    items.add(str(item))
    return len(ws), len(hit), sorted(items)


def test_decontamination_against_brute_force(spark, odd, none, monkeypatch):
    rng = random.Random(4)
    bench = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 5, 12, 13, 14, 20])))) for i in range(40)] + [(50, None), (51, ""), (None, "a a a"), (52, "É, über! x9"), (3, "b b a")]
    texts = ["".join(rng.choice(["a ", "B,", "b\n", "a-", "c "]) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["é über x9", "É ÜBER X9", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bdf = spark.createDataFrame(bench, "item_id long, text string")
    want = {i: brute_hits(t, [b for b in bench if b[0] is not None]) for i, t in enumerate(texts)}
    for block in (decontamination.BLOCK_BYTES, 200):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.find_contamination(df, bdf, block_bytes=block).collect()}
        assert got == want
    monkeypatch.setattr(decontamination, "ABREAST", 2)  # rows are written between blocks
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.find_contamination(df, bdf, block_bytes=100).collect()} == want
    clean = decontamination.drop_contaminated(df, bdf)
    assert {r.doc_id for r in clean.collect()} == {i for i, (n, h, _) in want.items() if not (h > 0 and 20 * h >= n)}
    assert decontamination.drop_contaminated(odd, bdf).columns == odd.columns
    assert decontamination.find_contamination(odd, bdf.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.find_contamination(none, bdf).count() == 0


def test_decontamination_tables_are_compact():
    """Seven bytes of table for a byte of benchmark, and no window is lost among many."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([4, 13, 60, 200]))).encode() for _ in range(4000)]
    classes = decontamination.window_classes(enumerate(items))
    own = classes[0].items
    size = len(own.text) + own.hash.nbytes + own.at.nbytes + sum(c.shift.nbytes + c.key.nbytes + c.start.nbytes for c in classes)
    assert size < 8 * sum(map(len, items))
    for k in rng.sample(range(4000), 200):
        w = items[k].split()
        text = [b"zz"] * rng.randint(0, 20) + w + [b"zz"] * 3
        hit, found = bytearray(len(text)), set()
        for c in classes:
            c.scan(text, decontamination.hashes(text), hit, found)
        assert hit.count(1) == len(w) and k in found


# 6


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    hs = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(spark, docs, odd):
    for df in (docs, odd.where("doc_id is not null")):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
        links = [(a, b) for a, x in rows for b, y in rows if a < b and bin(x ^ y).count("1") <= 2]
        want = classes({i for i, _ in rows}, links)
        got = simhash.near_duplicates(df).collect()
        assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == sorted((i, x, want[i]) for i, x in rows)


def test_very_long_texts_are_cut_into_blocks():
    """Beyond 65,280 shingles, and beyond 2 ** 18 code points, the blocks give what one block would."""
    rng = random.Random(17)
    text = " ".join(rng.choice(["ab", "cd", "é", "fgh", "ij"]) + str(rng.randrange(50)) for _ in range(70_000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    assert len(text) > toxicity.CHUNK
    whole = toxicity.buckets(text)
    try:
        toxicity.CHUNK, before = 1 << 30, toxicity.CHUNK
        assert np.array_equal(whole, toxicity.buckets(text))
    finally:
        toxicity.CHUNK = before


def test_simhash_index_loses_no_link(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b for b in base}
    for b in base:
        for _ in range(60):
            b ^= 1 << rng.randrange(64)
            fps.add(b)
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    rows = list(enumerate(sorted(fps)))
    want = classes({i for i, _ in rows}, [(a, b) for a, x in rows for b, y in rows if a < b and bin(x ^ y).count("1") <= 2])
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, i) for i, x in rows], "fp long, rep long")
    for split, frontier, batch in ((simhash.SPLIT, simhash.FRONTIER, simhash.ROWS), (3, 64, 8)):
        monkeypatch.setattr(simhash, "SPLIT", split)
        monkeypatch.setattr(simhash, "FRONTIER", frontier)
        monkeypatch.setattr(simhash, "ROWS", batch)
        got = {r.node: r.root for r in components(simhash.link_forest(df)).collect()}
        assert {i: got.get(i, i) for i, _ in rows} == want


def test_simhash_keeps_one(spark, odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None", "None"]
    assert simhash.keep_one(none).count() == 0


# 7


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, t or "") if ok(m)]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = [*"ab1234567890.@-+ ()%_é😀\n", "4111111111111111", "192.168.0.1", "a@b.co", "+1 (555) 123-4567", "4111 1111-1111 1111"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(400)] + ["1" * 30000, "1.1." * 3000, "a@" + "b." * 9000, "1 " * 9000, "+1" + "." * 9000, "256.1.1.1 00001.2.3.4", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", pii.base_spans(F.col("t")).alias("s")).collect()
    kinds = list(pii.PATTERNS)
    assert {r.i: [(kinds[s.kind], s.start, s.end) for s in r.s] for r in rows} == {i: brute_spans(t) for i, t in enumerate(texts)}


def private(n=60):
    rng = random.Random(8)
    noise = ["lorem", "ipsum", "dolor", "amet", "elit", "magna"]
    rows = [(i, " ".join(rng.choice(noise) for _ in range(30))) for i in range(n)]
    for i in range(3):
        rows[i] = (i, f"{rows[i][1]} the Zanzibarian magna writes from anna@x.org today " + rows[i][1])
    rows[3] = (3, rows[3][1] + " ZANZIBARIAN lorem")
    return rows


def test_disclosing_terms(spark):
    rows = private()
    found, terms = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    digest = {r.doc_id: r.digest for r in found.collect()}
    spans = {r.digest: r.terms for r in terms.collect()}
    text = dict(rows)
    marked = {i: {text[i][s.start : s.end] for s in spans.get(digest[i], [])} for i, _ in rows}
    assert marked[0] >= {"Zanzibarian", "writes"} and marked[3] == {"ZANZIBARIAN"}
    assert not any(marked[i] for i in range(4, 60)) and "magna" not in set().union(*marked.values())
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "anna" not in clean[0] and "[EMAIL]" in clean[0] and "anzibarian" not in clean[0].lower() + clean[3].lower()
    assert all(clean[i] == text[i] for i in range(4, 60))


def brute_terms(texts, n_docs):
    """Disclosing terms -> whether wholly, by the definition, over a list of texts with repeats."""
    import math

    import regex

    words_ = lambda t: {m[0].lower() for m in regex.finditer(r"\p{L}{2,}", t)}

    def beside(t):
        mails = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        return {m[0].lower() for m in regex.finditer(r"\p{L}{2,}", t) if not any(m.start() <= e and m.end() >= s for s, e in mails)}

    values = lambda t: {f"{k}:{t[s:e].lower()}" for k, s, e in brute_spans(t)}
    out = {}
    for c in set().union(*map(values, texts)):
        with_c = [t for t in texts if c in values(t)]
        for t in set().union(*map(beside, with_c)):
            both = [x for x in with_c if t in beside(x)]
            n_c, n_ct, n_t = len(with_c), len(both), sum(t in words_(x) for x in texts)
            ic, pmi = math.log2(n_docs / n_c), math.log2(n_ct * n_docs / (n_c * n_t))
            if len(set(with_c)) >= 2 and len(set(both)) >= 2 and pmi > 0 and pmi >= pii.DISCLOSURE * ic and ic - pmi <= pii.HIDDEN:
                out[t] = out.get(t, False) or n_ct == n_t
    return out


def test_disclosing_terms_against_brute_force(spark, tmp_path):
    import regex

    rng = random.Random(21)
    common, names = ["the", "of", "mail", "Über", "to", "é", "word"], ["Ana", "Li", "Quinn", "Zoë", "Marsh", "Okafor", "Bo"]
    values = ["a@b.org", "c.d@e.com", "10.0.0.1", "+1 (555) 123-4567", "4111 1111 1111 1111", "ana@li.org"]
    rows = []
    for i in range(160):
        w = rng.choices(common, k=rng.randint(0, 12))
        if i % 3 == 0:
            k = rng.randrange(len(values))
            w += [values[k], names[k], "Only" + "abcdef"[k]] + rng.choices(names, k=rng.randint(0, 1))
        if i % 17 == 0:
            w += rng.choices(names, k=1)
        rng.shuffle(w)
        rows.append(" ".join(w))
    rows += rows[:9] + [None, ""]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    terms = brute_terms([t or "" for t in rows], len(rows))
    assert {True, False} == set(terms.values())
    for r in pii.op7_pii(spark, str(tmp_path)).collect():
        t = rows[r.doc_id] or ""
        base = brute_spans(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in pii.PATTERNS]
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        own = [("term", *m.span()) for m in regex.finditer(r"\p{L}+", t) if m[0].lower() in terms]
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in [*base, *own])


def test_terms_count_wherever_they_stand(spark):
    """At the edges of a text and far from the value, in every document that holds both."""
    far = " lorem ipsum dolor" * 60
    near = [f"Quillfeather a@b.org {i}" for i in range(3)] + [f"mail c@d.org {i} Marchbanks" for i in range(3)]
    rows = near + [f"e@f.org{far} {i}{far} Oldacre lorem" for i in range(3)] + [f"g@h.org Tidewater {i}" if i < 2 else f"g@h.org{far} {i} Tidewater" for i in range(6)]
    rows += [f"ééééjo@k.org {i} jo@k.orgéééé café.jo@k.org" for i in range(3)] + [f"lorem ipsum dolor mail {i}" for i in range(200)]
    clean = [r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()]
    assert not [t for t in clean if re.search("quillfeather|marchbanks|oldacre|tidewater|café", t, re.I)]
    assert sum("éééé" in t for t in clean) == 3 and all("lorem" in t for t in clean if "ipsum dolor" in t)


def test_terms_are_counted_and_placed_by_one_rule_of_case(spark):
    """Letters whose lower case is longer, differs at the end of a word, or has two capitals; a text with the term alone is cleaned too."""
    rows = [f"İstanbullu yazar {i} ann@x.org" for i in range(3)] + ["İSTANBULLU", "bir istanbullu"]
    rows += [f"GROẞMEIER schrieb {i} bob@y.org" for i in range(2)] + ["großmeier allein"] + [f"ΣΟΦΟΣ έγραψε {i} cy@z.org" for i in range(2)] + ["ο σοφος μόνος", "ο Σοφοσ"]
    rows += [f"yazar schrieb έγραψε {i}" for i in range(200)]
    found = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    clean = [r.text for r in pii.sanitise(found).orderBy("doc_id").collect()]
    assert not [t for t in clean if re.search("stanbullu|gro(ß|ẞ)meier|σοφο[σς]", t, re.I)]
    assert all(w in " ".join(clean) for w in ("yazar", "schrieb", "έγραψε")) and clean[3] == "[TERM]" and clean[4] == "bir [TERM]"


def test_folding_keeps_every_place(spark):
    import unicodedata

    letters = [(c,) for c in map(chr, range(0x20000)) if unicodedata.category(c)[0] == "L"]
    df = spark.createDataFrame(letters, "c string").withColumn("f", pii.folded(F.concat(F.lit("a"), "c", F.lit("b"))))
    df = df.where(F.col("c").rlike(r"^\p{L}$"))  # of the letters that Java knows
    assert df.count() > 60_000 and df.where((F.length("f") != 3) | ~F.col("f").rlike(r"^a\p{L}b$")).count() == 0


def test_personal_data_on_odd_input(spark, odd, none):
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns
    assert sorted(map(str, clean.collect())) == sorted(map(str, odd.collect()))
    assert pii.sanitise(none).count() == 0


# 8


def test_mixing_meets_targets(spark, docs, odd, none):
    for df in (docs, odd):
        rows = mixing.mix(df).collect()
        assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(r.doc_id), len(words(r.text))) for r in df.collect())
        by = defaultdict(list)
        for r in rows:
            by[r.source].append(r)
        names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        size = {s: sum(r.size for r in by[s]) for s in names}
        target, open_, left = {}, set(names), float(sum(size.values()))
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            full = {s for s in open_ if share[s] > 3 * size[s]}
            if not full:
                break
            for s in full:
                target[s] = 3.0 * size[s]
            open_ -= full
            left = sum(size.values()) - sum(target.values())
        target |= share
        for s in names:
            assert by[s][0].target == pytest.approx(target[s]) and by[s][0].source_size == size[s]
            assert abs(sum(r.taken for r in by[s]) - target[s]) <= 1
            assert all(0 <= r.taken <= 3 * r.size for r in by[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.mix(none).count() == 0


# 9


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 24)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 16))
    x[:150] = x[0] + 0.12 * rng.standard_normal((150, 16))
    for i in range(150, 400, 2):
        x[i + 1] = x[i] + 0.1 * rng.standard_normal(16)
    x[400:420] = x[400]
    vectors = [v.astype(np.float32).tolist() for v in x] + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, x[400].astype(np.float32).tolist()[:8], [-0.0] * 16]
    rows = list(enumerate(vectors))
    unit = np.array([v if i < 500 else [0.0] * 16 for i, v in rows], np.float64)
    unit[:500] /= np.linalg.norm(unit[:500], axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = classes(range(len(rows)), list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    found = sum(got[i].n_links for i in got)
    assert 0.97 * near.sum() <= found <= near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in got)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(500, len(rows)))
    assert np.mean([got[i].component_id == want[i] for i in got]) > 0.98
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_on_odd_input(spark):
    """Null ids, repeated rows, columns with the names used inside, doubles, and rows that never link."""
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [2.0, 0.0]), (4, [2.0, 0.0]), (2, [0.0, 5.0]), (None, [0.0, -3.0]), (7, None), (None, None), (9, [1.0]), (3, [1e300, 1e290]), (8, [1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("id", "key", "rep", "copies", "code", "codes", "block", "vector", "node", "root", "links"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted(map(str, (tuple(r) for r in embedding_dedup.near_duplicate_vectors(df).collect())))
    # The class without an id is not compared with others, but its rows link with each other.
    want = [(None, 1, None), (None, 1, None), (4, 3, 3), (4, 3, 3), (3, 3, 3), (8, 3, 3), (2, 0, 2), (None, 0, None), (7, 0, 7), (None, 0, None), (9, 0, 9)]
    assert got == sorted(map(str, want))


# 10


def test_licenses(spark, docs, odd, none):
    line = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("line")}
    got = licenses.scan_licenses(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    want = sorted((i, n, m.start(), m.end()) for i, t in text.items() for n, p in line.items() for m in re.finditer(re.escape(p.rstrip(".")), t))
    assert sorted((r.doc_id, r.license, r.start, r.end) for r in got) == want and all(r.coverage == 1 for r in got)
    edited = licenses.TEMPLATES["MIT"].replace("free of charge", "gratis").replace("merge, ", "").replace("substantial", "big")
    found = licenses.scan_licenses(spark.createDataFrame([(1, "é foo " * 30 + edited + " bar. " + edited)], "doc_id long, text string")).collect()
    assert [r.license for r in found] == ["MIT", "MIT"] and all(0.9 < r.coverage < 1 for r in found)
    assert licenses.scan_licenses(odd).count() == licenses.scan_licenses(none).count() == 0


def test_licenses_all_and_whole():
    index = licenses.Index(licenses.TEMPLATES)
    find = lambda t: [(n, s, e) for n, _, s, e in index.find(licenses.words_of(t.encode()))]
    line, mit = licenses.TEMPLATES["MIT-line"], licenses.TEMPLATES["MIT"]
    assert find(" ".join([line] * 9)) == [("MIT-line", 5 * i, 5 * i + 5) for i in range(9)]
    n = len(licenses.words_of(mit.encode()))
    for gap in range(5, 16):  # a quote of the first words shortly before the whole
        quote = " ".join(mit.split()[:5]) + " x" * (gap - 5)
        assert find(f"{quote} {mit}") == [("MIT", gap, gap + n)]
    for name, text in licenses.TEMPLATES.items():
        size = len(licenses.words_of(text.encode()))
        assert find(f"a b c {text} d e f {text}") == [(name, 3, 3 + size), (name, 6 + size, 6 + 2 * size)], name
    assert {"BSD-3-Clause", "LGPL-2.1-notice", "AGPL-3.0-notice", "GPL-2.0-notice"} <= set(licenses.TEMPLATES)


def subsequence(a, b):
    """Length of the longest common subsequence of two lists, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_licenses_against_all_subsequences():
    """1 to 40 words put in, left out or changed at one place: every template that a text still covers is found, as covered."""
    index, rng, named = licenses.Index(licenses.TEMPLATES), random.Random(10), 0
    size = {n: len(w) for n, w in zip(index.names, index.words, strict=True)}
    long = [(n, w) for n, w in zip(index.names, index.words, strict=True) if len(w) >= 20]
    assert len(index.names) >= 20
    for k in [1, 2, 3, 5, 6, 7, 9, 12, 20, 30, 40]:
        for how in ("in", "out", "changed"):
            for name, w in rng.sample(long, 6):
                at = rng.randrange(4, len(w) - 4)
                k_ = min(k, len(w) - 4 - at) if how != "in" else k
                new = [b"zz%d" % i for i in range(k_)] if how != "out" else []
                edited = w[:at] + new + (w[at:] if how == "in" else w[at + k_ :])
                text = [b"xx"] * 30 + edited + [b"yy"] * 30
                found = index.find(text)
                covers = subsequence(w, edited) / len(w)
                if covers < licenses.COVER:
                    continue
                # Of overlapping matches the best stays, words between counting half against it; another may stand beside it.
                value = [c * size[n] - (e - s - c * size[n]) / 2 for n, c, s, e in found]
                assert found and max(value) >= covers * len(w) - len(new) / 2 - 1e-6, (name, how, k, found)
                own = [(c, s, e) for n, c, s, e in found if n == name]
                assert not own or (own[0][0] == pytest.approx(covers) and 30 <= own[0][1] < own[0][2] <= 30 + len(edited))
                named += bool(own)
    assert named > 100
    mit = index.words[index.names.index("MIT")]
    for k in (5, 7, 9, 12, 20, 40):
        m = len(mit) // 2
        assert index.find(mit[:m] + [b"zz"] * k + mit[m:]) == [("MIT", 1.0, 0, len(mit) + k)]
    # Edited at several places, twice in a text, with a line between.
    twice = mit[:20] + [b"zz"] * 9 + mit[20:60] + mit[64:110] + [b"zz"] * 11 + mit[110:]
    line = index.words[index.names.index("MIT-line")]
    assert [n for n, *_ in index.find(twice + [b"zz"] * 3 + line + twice)] == ["MIT", "MIT-line", "MIT"]
    assert index.find(line + line[1:] + line[:4]) == [("MIT-line", 1.0, 0, 5), ("MIT-line", 0.8, 5, 9), ("MIT-line", 0.8, 9, 13)]


def test_licenses_that_differ_by_a_word_are_told_apart():
    index = licenses.Index(licenses.TEMPLATES)
    name = lambda text: [n for n, *_ in index.find(licenses.words_of(text.encode()))]
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v in ("3.0", "4.0"):
            assert name(f"The text is licensed under CC {kind} {v} since then.") == [f"CC-{kind}-{v}-line"]
    assert name("Licensed under CC BY-XX 4.0.") == name("Licensed under CC BY 5.0.") == []
    for said, want in (("General", "GPL-2.0"), ("General", "GPL-3.0"), ("Lesser General", "LGPL-2.1"), ("Lesser General", "LGPL-3.0"), ("Affero General", "AGPL-3.0")):
        v = want.rpartition("-")[2].removesuffix(".0")
        assert name(f"This work is licensed under the GNU {said} Public License, version {v}.") == [f"{want}-line"]
    assert name("This work is licensed under the GNU General Public License, version 4.") == name("This work is licensed under the GNU Free General Public License, version 3.") == []


# the pipeline


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.kept(stage(spark, docs, SF))
        assert docs.columns == columns, name
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            fps = {i: brute_fingerprint(t) for i, t in before.items()}
            want = classes(fps, [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2])
            assert set(after) == {i for i, c in want.items() if i == c}
        if name == "decontamination":
            bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            hits = {i: brute_hits(t, bench) for i, t in before.items()}
            assert set(after) == {i for i, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
        if name == "personal_data":
            assert set(after) == set(before)
            assert not any(brute_spans(t) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not brute_spans(t))
        before = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.size for r in mixed} == {i: len(words(t)) for i, t in before.items()}
    assert sorted(map(str, mixed)) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))


def test_pipeline_on_odd_and_empty_input(spark, odd, none, tmp_path):
    """Each stage on nulls, empty and very long texts, repeated rows and clashing columns, and on no rows at all."""
    spark.createDataFrame([(3, 1, 0), (2, None, None), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of the kind"), (2, None), (None, "one two")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, none, str(tmp_path))
        assert empty.count() == 0, name
        got = stage(spark, odd, str(tmp_path))
        if name == "mixing":
            assert got.count() == len(ODD)
            continue
        assert got.columns == odd.columns and empty.columns == none.columns, name
        before = [(r.doc_id, r.text) for r in odd.collect()]
        after = [(r.doc_id, r.text) for r in got.collect()]
        assert all(x in before for x in after), name
        if name == "near_duplicates":  # one of the texts without words, of each repeated one, and what has no id
            assert sorted(map(str, (i for i, _ in after))) == ["1", "3", "4", "None", "None"]
        if name in ("decontamination", "personal_data"):
            assert len(after) == len(before)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
