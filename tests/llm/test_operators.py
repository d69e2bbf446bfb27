"""Brute force, round trips and edge rows for the training-data operators."""

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from comuna.llm import bpe, chat, decontaminate, order_minhash, quality, simhash, token_counts, token_files, toxicity, warc

P = pytest.importorskip("public_tokenizers")

WORDS = "rain river stone letter window garden silver morning little number market bridge yellow simple travel winter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "s", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(1, "same text here", 0), (1, "same text here", 1), (2, None, 0), (3, "", 0), (None, "no id", 0), (None, None, 1), (4, "x" * 40_000, 0), (5, "😀 ñandú\u0000 fin", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids_crc long").withColumnsRenamed({"ids_crc": "score"}).withColumns({"start": F.lit(1), "n_tokens": F.lit(2)})


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder_of(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)


# --- 1 ---


def test_order_minhash_brute_force():
    hasher = order_minhash.OrderMinHash(k=3, tuple_size=2, elements=16)
    text = "abcabcabdabcabc"
    points = order_minhash.code_points(text)
    kmers = order_minhash._mix(hasher._kmers(points))
    seen, numbered = {}, []
    for h in kmers.tolist():
        numbered.append(int(order_minhash._mix(np.array([h], np.uint64) + np.array([seen.get(h, 0)], np.uint64) * order_minhash._ODD)[0]))
        seen[h] = seen.get(h, 0) + 1
    want = []
    mask = ~((1 << 20) - 1)
    for start in hasher.starts.tolist():
        # The order of element i: (hash - start) mod 2**64, hashes with their place in the low bits.
        least = sorted(range(len(numbered)), key=lambda j: (((numbered[j] & mask) | j) - start) % 2**64)[:2]
        value = np.array([2], np.uint64)
        for j in sorted(least):
            value = order_minhash._mix(value * order_minhash._ODD + np.array([numbered[j]], np.uint64))
        want.append(int(value[0] >> np.uint64(48)))
    assert hasher.sketch(points).tolist() == want


def test_edit_probe(spark, edge_docs):
    rng = random.Random(1)
    texts = {i: prose(rng, rng.randint(1, 60)) for i in range(0, 90, 3)}
    got = order_minhash.edit_probe(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).toPandas().set_index("doc_id")
    keys = sorted(texts)
    hasher = order_minhash.OrderMinHash()
    for i, key in enumerate(keys):
        own, following = texts[key], texts[keys[(i + 1) % len(keys)]]
        cut = len(own) // 4
        edited = own[: len(own) - cut] + following[:cut]
        a, b, c = (hasher.sketch(order_minhash.code_points(t)) for t in (own, edited, following))
        row = got.loc[key]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and row["n_chars"] == len(own)
        assert row["fingerprint"] == order_minhash.as_hex(a) and row["edited_fingerprint"] == order_minhash.as_hex(b)
        assert row["near_edited"] == order_minhash.likeness(a, b) and row["near_next"] == order_minhash.likeness(a, c)
    assert order_minhash.edit_probe(edge_docs).count() == edge_docs.count()
    assert order_minhash.edit_probe(edge_docs.limit(0)).count() == 0
    assert order_minhash.edit_probe(edge_docs.where("doc_id = 4")).first()["near_next"] == 1.0
    prints = {r["fingerprint"] for r in order_minhash.order_minhash(edge_docs.where("doc_id = 1")).collect()}
    assert len(prints) == 1


# --- 2 ---


def edits_in(pattern, text):
    """Least edits of the pattern against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_misses_no_passage_within_budget(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, 14)) for i in range(6)]
    docs, want = [], set()
    normal = decontaminate.Normal()
    fold = lambda t: "".join(map(chr, normal(t)[0].tolist()))
    for d in range(40):
        text = prose(rng, 30)
        if d % 2:
            passage = list(items[d % 6][1])
            for _ in range(rng.randint(0, 14)):
                passage[rng.randrange(len(passage))] = rng.choice(["", "q", "zz"])
            text = text[:50] + " " + "".join(passage) + " " + text[50:]
        docs.append((d, text))
        for i, item in items:
            pattern = fold(item)
            if edits_in(pattern, fold(text)) <= decontaminate.budget(len(pattern)):
                want.add((d, i))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    assert all(0 <= r["begin"] < r["end"] <= len(dict(docs)[r["doc_id"]]) for r in got)


def test_decontamination_in_blocks(spark, monkeypatch):
    """Several indexes give what one gives, and each is built once and loaded once for a whole batch."""
    rng = random.Random(9)
    items = [(i, prose(rng, 30)) for i in range(30)]
    docs = [(d, prose(rng, 20) + " " + items[d % 30][1] + " " + prose(rng, 20)) for d in range(60)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_leaks(frame, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    indexes, loads = decontaminate.indexed(bench), []
    assert 3 <= len(indexes) <= 6 and sorted(map(tuple, decontaminate.find_leaks(frame, bench).collect())) == whole and len({d for d, *_ in whole}) == 60
    found = decontaminate.leaks_in(pa.array([t for _, t in docs] * 40), indexes, lambda uri: loads.append(uri) or decontaminate.windows_at(uri))
    assert loads == indexes and sorted((d, *leak) for (d, _), mine in zip(docs, found) for leak in mine) == whole


def test_decontamination_edges(spark, edge_docs):
    bench = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "no id"), (4, "the rain falls on the little river and the garden")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["begin"], r["end"]) for r in decontaminate.find_leaks(edge_docs, bench).collect()] == [(None, 3, 0, 5)]
    assert decontaminate.without_leaks(edge_docs, bench).columns == edge_docs.columns
    assert decontaminate.find_leaks(edge_docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(edge_docs.limit(0), bench).count() == 0


# --- 3 ---


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "", None, "<\\s> \\[INST]", "[\\/INST]", " <s>", "<</SYS>>", "a\nb", "[ROLE] x [SEP] y [/ROLE]", "<<\\SYS>> <\\</SYS>>", "$1 \\2"]
    roles = ["user", "assistant", "system", "tool", None, "[SEP]"]
    rows = [(c, t, roles[(c + t) % 6], texts[(c * 5 + t * 3) % len(texts)]) for c in range(12) for t in range(c % 5 + 1)] + [(None, None, "user", "u"), (3, None, "user", "first")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("lost", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r[2], r[3]) for r in mine]
        assert got[conv]["lost"] == "".join(r[3] for r in mine if r[2] == "assistant")
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 4 and 6 ---


def test_toxicity(spark, edge_docs):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(rng, 30)
        docs.append((i, text + " so a blockhead" + rng.choice(["s", "", "ery"]) if bad else text))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(lexicon.weights) == {toxicity.fold("blockhead")}
    probe = spark.createDataFrame([(1, "you bl0ckh3ads"), (2, "you Ьlосkhеаd"), (3, "a block of heads"), (4, None), (5, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(probe, lexicon).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    lexicon.exceptions = ("blockhead award",)
    assert toxicity.Matcher(lexicon).hits("The Blockhead award!")[0] == [] and toxicity.Matcher(lexicon).hits("blockhead")[0]
    assert toxicity.score(edge_docs, lexicon).count() == edge_docs.count()
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.weights == {} and toxicity.score(edge_docs.limit(0), none).count() == 0


def test_toxicity_counts_copies_once(spark):
    # Of 240 toxic documents with the insult 120 are near copies of one text; all documents share a line.
    rng = random.Random(3)
    line = " this line is found at the head of every page here "
    copied = prose(rng, 40).split()
    docs = [(i, line + prose(rng, 40)) for i in range(800)] + [(1000 + i, line + prose(rng, 40) + " you blockhead") for i in range(120)]
    for i in range(120):
        words = list(copied)
        words[rng.randrange(40)] = f"w{i}"
        docs.append((2000 + i, line + " ".join(words) + " what marmalade you blockhead"))
    labels = [(i, 1, int(i >= 1000)) for i, _ in docs]
    lexicon = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(lexicon.weights) == {toxicity.fold("blockhead")}


def test_held_out_accuracy(spark):
    from comuna.llm.queries import op4_toxicity, op6_quality

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for found, label in ((op4_toxicity(spark, sf), "toxic"), (op6_quality(spark, sf), "quality")):
        rows = found.join(labels, "doc_id").where("held_out").toPandas()
        assert (rows["predicted"] == rows[label]).mean() > 0.9 and rows["score"].between(0, 1).all()


def test_quality_edges(spark, edge_docs):
    assert {r["score"] for r in quality.score(edge_docs, None).collect()} == {0.5}
    assert quality.learn(edge_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None


# --- 5 ---


def test_token_files(spark, edge_docs, tmp_path):
    from tokenizers import Tokenizer

    files = token_files.write_tokens(edge_docs, f"file://{tmp_path}/ids")
    got = token_files.read_tokens(files, with_ids=True).collect()
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in edge_docs.collect()])
    at, want = 0, []
    for there, doc_id, text in rows:
        ids = own.encode(text, add_special_tokens=False).ids + [1]
        want.append((doc_id if there else None, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    path = files.orderBy("range").first()["path"].removeprefix("file://")
    data = open(path, "rb").read()
    with pa.OSFile(path) as f:
        reader = token_files.TokenFileReader(f)
        assert [d for d, _ in reader.find({1})] == [d for d, _ in reader if d == 1]
    broken = bytearray(data)
    broken[12] ^= 1
    with pytest.raises(Exception):  # noqa: B017  the checksum or the frame itself tells
        list(token_files.TokenFileReader(pa.BufferReader(bytes(broken))))
    assert token_files.round_trip(edge_docs.limit(0)).count() == 0


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    texts = ["Don't stop  2024, Ñandú!", "", "tab\tand\nline <|endoftext|>", "日本 語"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        definition = open(P.path(name), encoding="utf-8").read()
        encoder, own = token_files.WordEncoder(definition), Tokenizer.from_str(definition)
        assert encoder.modelled == (name == "word_bpe_49k.json")
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


# --- 7 and 8 ---


def test_bpe_is_tiktoken(spark, edge_docs, encoder):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(4)
    letters = "aab '\n\t\r  \x1c\x85's'll²½é日本x1２.!😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["a" * k for k in range(80)]
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode_many(texts)] == [own.encode_ordinary(t) for t in texts]
    long = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    assert encoder.encode(long) == own.encode_ordinary(long)
    for r in bpe.encode_and_decode(edge_docs).collect():
        assert r["ids"] == own.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    encoded = bpe.encode(edge_docs)
    assert [bytes(r["decoded"]) for r in bpe.decode(encoded).collect()] == [(r["text"] or "").encode() for r in encoded.collect()]
    assert bpe.encode(edge_docs.limit(0)).count() == 0


def test_bpe_is_tiktoken_where_unicode_versions_differ(encoder):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for name in (r"\p{L}", r"\p{N}", r"\s"):  # every code point alone
        asked = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        assert "".join(bpe.Pretokens(name).exact.findall("".join(every))) == asked.decode_bytes(asked.encode_ordinary("".join(every))).decode()
    odd = [c for c in every if not c.isascii() and encoder.pretokens.odd(c)]
    rng = random.Random(6)
    points = rng.sample(odd, min(len(odd), 1500)) + rng.sample(every, 1500)
    texts = [frame.format(c) for c in points for frame in ("{}'s", "a{}b", " {}1", "x {}.", "{}")]
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode_many(texts)] == own.encode_ordinary_batch(texts, num_threads=4)


def test_edited_counts_where_unicode_versions_differ(encoder):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng, letters = random.Random(8), "ab's 1\U00018f29\u0558\U00012550é"
    for _ in range(300):
        tree = token_counts.TokenTree("".join(rng.choice(letters) for _ in range(rng.randint(0, 200))), encoder)
        for _ in range(4):
            tree.edit(rng.randint(0, 200), rng.randint(0, 9), "".join(rng.choice(letters) for _ in range(rng.randint(0, 9))))
            assert tree.tokens == len(own.encode_ordinary(tree.text))


def test_edited_counts(spark, encoder):
    rng = random.Random(3)
    letters = "aab '\n\t  'sllre 12.!é"
    rows = []
    for k in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 300, 3000])))
        edits = [(rng.randint(-1, len(text) + 2), rng.choice([0, 1, 3, 50, 2000]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 10, 700])))) for _ in range(rng.randint(0, 6))]
        rows.append((k, text, edits))
    rows += [(None, None, None), (1, None, [(0, 0, None), (None, 1, "x"), None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,length:int,text:string>>")
    got = {r["doc_id"]: r for r in token_counts.count_edits(df.where("doc_id is not null and text is not null")).collect()}
    for k, text, edits in rows[:300]:
        now = text
        for s, n, new in edits:
            s = min(max(s, 0), len(now))
            now = now[:s] + new + now[s + n :]
        r = got[k]
        assert (r["n_tokens"], r["edited_tokens"], r["edited_chars"]) == (len(encoder.encode(text)), len(encoder.encode(now)), len(now))
    assert token_counts.count_edits(df).count() == len(rows)


# --- 9 ---


def test_warc(spark, tmp_path):
    big = "<p>" + "y" * 2000
    rows = [(1, "http://a/\n", big, 0), (7, "u", big, 0), (7, "u", big, 1), (3, None, "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (None, "u", big, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=repr)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(1, 2003, sha(big), "revisit", 7), (7, 2003, sha(big), "response", None), (7, 2003, sha(big), "response", None), (None, 2003, sha(big), "revisit", 7)]
    want += [(3, 5, sha("small"), "response", None), (4, 5, sha("small"), "response", None), (5, 0, sha(""), "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0
    out = io.BytesIO()
    out.close, keep = lambda: None, [b"%d" % i * 300 for i in range(100)]
    writer = warc.ArchiveWriter(out)
    for i, payload in enumerate(keep):
        writer.add(warc.record(i, "u", payload, hashlib.sha1(payload).hexdigest(), None))
    writer.close()
    data = out.getvalue()
    assert struct.unpack("<II", data[:8])[0] == warc.SKIPPABLE and struct.unpack("<II", data[:8])[1] > 0
    assert [warc.read_record(f)["payload"] for f in warc.frames(io.BytesIO(data))] == keep
    with pytest.raises(warc.BadRecord):
        list(warc.frames(io.BytesIO(data[:-3])))
    with pytest.raises(warc.BadRecord):
        warc.read_record(warc.record(1, "u", b"abc", "0" * 40, None))


# --- 10 ---


def components_of(nodes, linked):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("hot", [50_000, 3])
def test_simhash_components_brute_force(spark, hot):
    rng = random.Random(8)
    base = [prose(rng, 80) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(base)] + [(100 + i, " ".join(w if rng.random() > 0.01 else "zz" for w in base[i % 6].split())) for i in range(60)] + [(300, None), (301, " \t"), (302, "a b")]
    fps = {i: simhash.majority(simhash.shingle_hashes(t, 4)) for i, t in docs}
    want = components_of(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    got = simhash.simhash_components(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == fps


def test_simhash_edges(spark, edge_docs):
    assert simhash.simhash_components(edge_docs).count() == edge_docs.count()
    assert simhash.simhash_components(edge_docs.limit(0)).count() == 0
    groups = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(edge_docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_duplicates_around_the_threshold(spark):
    rng = random.Random(11)
    docs = []
    for i in range(500):  # pairs that share all but the last words, at 0.7 to 0.9
        n = rng.choice([12, 20, 60, 150, 400])
        words = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)]
        like = rng.uniform(0.7, 0.9)
        cut = max(1, round((n - 4) * (1 - like) / (1 + like)))
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-cut], *(f"zz{k}" for k in range(cut))]))]
    base = [f"{w}{k}" for k, w in enumerate(WORDS * 8)]
    for i in range(60):  # one group whose pairs lie on both sides
        docs.append((2000 + i, " ".join(w if rng.random() > 0.02 else f"q{i}" for w in base)))
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in docs}
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string"), block=1500).collect()}
    pairs = [(2 * i, 2 * i + 1) for i in range(500)]
    true = [p for p in pairs if jaccard(sets[p[0]], sets[p[1]]) >= 0.8]
    assert all(got[a] != got[b] for a, b in set(pairs) - set(true)) and 150 < len(true) < 350
    assert sum(got[a] == got[b] for a, b in true) >= 0.98 * len(true)
    group = range(2000, 2060)
    want = components_of(group, [(a, b) for a in group for b in group if a < b and jaccard(sets[a], sets[b]) >= 0.8])
    assert {i: got[i] for i in group} == want and len(set(want.values())) > 1


# --- pipeline ---


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    bad = {r["doc_id"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).where("predicted = 1").collect()}
    kept = pipeline.drop_toxic(spark, docs, sf)
    assert ids(kept) == ids(docs) - bad and kept.columns == docs.columns
    kept = pipeline.drop_near_duplicates(spark, docs, sf)
    groups = simhash.near_duplicate_groups(docs).collect()
    assert ids(kept) == {r["group_id"] for r in groups} and kept.columns == docs.columns
    shingles = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in docs.collect()}
    of = {r["doc_id"]: r["group_id"] for r in groups}
    for a in shingles:
        for b in shingles:
            if a < b and shingles[a] and shingles[b]:
                like = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
                assert like < 0.9 or of[a] == of[b]
    leaks = ids(decontaminate.find_leaks(docs, bench))
    assert ids(pipeline.drop_contaminated(spark, docs, sf)) == ids(docs) - leaks
    done = pipeline.run(spark, sf)
    assert done.columns == ["doc_id", "n_tokens", "ids"] and 0 < done.count() < docs.count()


def test_pipeline_stages_on_edge_rows(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    base = docs.limit(60).collect()
    rows = [tuple(r) for r in base] + [tuple(base[0]), (base[0][0], "another text of this id", "en", None, 0), (None, None, None, None, None), (None, "", "en", "s", 0), (None, None, None, None, None), (10**9, None, None, None, None), (10**9 + 1, "", None, None, None), (10**9 + 2, "word " * 60_000, None, None, None)]
    edge = spark.createDataFrame(rows, docs.schema)
    for name in ("weight", "density", "toxic_score", "quality_score", "leaks", "_new", "Row_Hash", "ids", "decoded", "group_id", "code", "digest", "label", "a.b"):
        edge = edge.withColumn(name, F.lit(name))
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    for name, stage in pipeline.STAGES:
        found = stage(spark, edge, sf)
        kept = found.collect()
        assert stage(spark, edge.limit(0), sf).count() == 0
        if name == "byte_bpe":
            assert len(kept) == len(rows) and found.columns == ["doc_id", "n_tokens", "ids"]
            continue
        assert found.columns == edge.columns and all(r["weight"] == "weight" and r["a.b"] == "a.b" for r in kept)
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
            assert len(ids) == len(set(ids)) and sum(r["doc_id"] is None for r in kept) == 3
            assert sum(not texts[i] for i in ids) == 1
        elif name in ("toxicity", "decontamination"):
            assert sum(r["doc_id"] is None for r in kept) == 3


# --- brute force of the classifiers' parts ---


def test_exceptions_are_a_plain_scan():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({toxicity.fold(s): 1.0 for s in ("trash", "clown", "scum")}, ("trash can", "can trash", "class clown award"))
    matcher = toxicity.Matcher(lexicon)
    for _ in range(200):
        text = " ".join(rng.choice(["trash", "can", "class", "clown", "award", "scum", "scummy", "a"]) for _ in range(rng.randint(0, 25)))
        words = toxicity.fold(text).split()
        want = 0
        for i, w in enumerate(words):
            covered = False
            for phrase in lexicon.exceptions:
                p = toxicity.fold(phrase).split()
                covered |= any(words[j : j + len(p)] == p for j in range(max(0, i - len(p) + 1), i + 1))
            want += any(w.startswith(s) for s in lexicon.weights) and not covered
        assert len(matcher.hits(text)[0]) == want


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    p, u = rng.normal(2, 1, 3000), np.concatenate((rng.normal(2, 1, 4000), rng.normal(-2, 1, 6000)))
    cuts = np.quantile(p, quality.QUANTILES)
    assert abs(quality.estimate_prior(p, cuts, np.array([(u >= c).sum() for c in cuts]), len(u)) - 0.4) < 0.05


def test_repetitive_texts_stay_small():
    windows = decontaminate.Windows([(1, "ab" * 10_000), (2, "ab" * 10_000)])
    assert windows.leaks("ab" * 20_000) == [(1, 0, 40_000, 0), (2, 0, 40_000, 0)]
    text = "garden river stone " * 4 + "zzz " * 100 + "garden river stone " * 4
    found = decontaminate.Windows([(1, "garden river stone " * 4)]).leaks(text)
    assert len(found) == 2 and found[0][2] < found[1][1]


def test_warc_reads_other_records():
    block = b"software: x\r\n"
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\nwarc-record-id: <urn:uuid:1>\r\nwarc-date: 2024-01-01T00:00:00Z\r\ncontent-length: 13\r\n\r\n" + block + b"\r\n\r\n"
    found = warc.read_record(info)
    assert (found["type"], found["page_id"], found["payload"], found["payload_bytes"]) == ("warcinfo", None, block, 13)
    one = warc.record(5, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, mark="3.7")
    assert b"<urn:x-page:5:3.7>" in one and warc.read_record(one)["page_id"] == 5
