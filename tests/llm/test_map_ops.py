"""Language ID, packing, token counts and media columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("lineshed.llm")
from lineshed.llm import language_id, media_ts, packing, textops, token_counts  # noqa: E402
from lineshed.llm.queries import QUERIES, tokenizer_path  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "a", "Straße naïve\tcafé\n", "x" * 50_000, "<|endoftext|> it's 2024!!", "a\x1cb ćd", "日本語 テスト", "a", "\U0001f600 ok\x00z"]


def odd_docs(spark, extra=""):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_word_hashes_follow_words():
    a, b = textops.word_hashes("The  cat\nsat"), textops.word_hashes(" the CAT sat ")
    assert len(a) == 3 and (a == b).all()
    assert len(textops.shingle_hashes(textops.word_hashes("a b"))) == 1
    assert len(textops.shingle_hashes(textops.word_hashes("a b c d e f"))) == 2
    assert len(set(textops.word_hashes("ab ba a b aa bb aab").tolist())) == 7


def test_language_id_held_out(spark):
    from pyspark.sql import functions as F

    out = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    n, right = out.filter("held_out").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 20 and right / n > 0.95


def test_language_id_edges(spark):
    docs = odd_docs(spark)
    got = language_id.predict(docs, language_id.fit(docs)).collect()
    by_text = dict(zip([r["doc_id"] for r in got], [(r["lang_pred"], r["score"]) for r in got]))
    assert by_text[0] == ("und", 0.0) and by_text[1] == ("und", 0.0) and by_text[2] == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(ODD)
    none = language_id.fit(docs.filter("false"))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}


def test_long_texts_of_unseen_languages_go(spark):
    import corpus_pipeline

    rng = random.Random(6)
    scripts = [(0x430, 0x44F), (0x3B1, 0x3C9), (0x5D0, 0x5EA), (0x4E00, 0x9FA5), (97, 122)]
    unseen = [" ".join("".join(chr(rng.randint(*s)) for _ in range(rng.randint(2, 8))) for _ in range(n)) for s in scripts for n in (150, 1000)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = [r["text"] for r in docs.filter("length(text) > 500").limit(20).collect()]
    rows = [(-1 - k, t) for k, t in enumerate(unseen)] + [(-1000 - k, t) for k, t in enumerate(known)]
    frame = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, frame, SF).filter("doc_id < 0").collect()}
    assert kept == {-1000 - k for k in range(len(known))}


def test_language_id_is_the_bundle_by_hand():
    texts = ["abc ab", "zzz", "\u0436\u0434 a", "\u65e5\u672c"]

    def vector(cp, turn):
        return np.roll(language_id.letter_vectors(np.array([cp]), 64)[0], turn)

    prototype = np.rint(vector(ord("a"), 0) * 1000)
    p = language_id.Profiles(["x"], prototype[None])
    for text, score in zip(texts, p.score(texts)[1]):
        bundle = np.zeros(64)
        for word in text.split():
            w = [0, *map(ord, word), 0]
            for a, b, c in zip(w, w[1:], w[2:]):
                bundle += vector(a, 2) * vector(b, 1) * vector(c, 0)
        assert score == pytest.approx(max(0, bundle @ prototype / np.linalg.norm(bundle) / np.linalg.norm(prototype)), abs=1e-12)


def test_equal_texts_score_equally_in_any_batch(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghij klmno\u0416\u0434\u65e5", k=rng.randint(1, 3000))) for _ in range(40)]
    p = language_id.Profiles(["x", "y"], np.rint(np.random.default_rng(1).normal(size=(2, language_id.DIM)) * 1e5))
    whole = p.measure(texts)
    monkeypatch.setattr(language_id, "MOST_BOUND", 500)
    monkeypatch.setattr(language_id, "MOST_CELLS", 10)
    for k, t in enumerate(texts):
        one = p.measure([t])
        assert [x[0] for x in one] == [x[k] for x in whole]


def test_language_id_holds_a_part_of_a_batch_at_once():
    import tracemalloc

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=1200)) for _ in range(400)]
    p = language_id.Profiles(["x", "y"], np.rint(np.random.default_rng(1).normal(size=(2, language_id.DIM)) * 1e5))
    p.measure(texts[:1])
    tracemalloc.start()
    got = p.measure(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 90e6 and [x[7] for x in got] == [x[0] for x in p.measure(texts[7:8])]


def test_counted_trigrams_bind_to_the_same_sum(monkeypatch):
    texts = ["abc ab", "", "zz top \u0436\u0434", "abc abc", "\u65e5\u672c"]
    whole = language_id.bundle(*language_id.count_codes(texts), 64)
    monkeypatch.setattr(language_id, "MOST_CHARS", 8)
    monkeypatch.setattr(language_id, "MOST_BOUND", 3)
    parts = list(language_id.parts_of(texts))
    assert [t for part in parts for t in texts[part]] == texts and len(parts) > 2
    assert (language_id.bundle(*language_id.added([language_id.count_codes(texts[part]) for part in parts]), 64) == whole).all()


def test_tokenize_is_the_tokenizer(spark):
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [t or "" for t in ODD] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]
    texts += ["It's I'LL we'Ve 'S' don't''re x'", "ÀÉÎ ÿß straße.Ünd,ço", "a<|endoftext|>b <|x", "5²½ªº µ×÷ Σας ΣΑΣ İI", "\u00a0x\u2003y\x85z", "e\u0301 \u0301a"]
    rng = random.Random(8)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 384), rng.randrange(0x300, 0x3000)])) for _ in range(60)) for _ in range(100)]
    words = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    for text, got in zip(texts, words.ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == direct.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(5)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 40) for _ in range(rng.randint(0, 60))), reverse=True)
        bins, offsets = packing.first_fit_decreasing(np.array(lengths, dtype=np.int64), 40)
        used = []
        for length, b, o in zip(lengths, bins, offsets):
            first = next((k for k, u in enumerate(used) if u + length <= 40), len(used))
            if first == len(used):
                used.append(0)
            assert (b, o) == (first, used[first])
            used[first] += length


def test_packing_query(spark):
    rows = QUERIES["op10_packing"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == docs.keys()
    for doc, parts in pieces.items():
        ids = words.ids([docs[doc] or ""])[0] + np.array([2], "<u4").tobytes()
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    fill = sum(r["length"] for r in rows) / (4096 * len(sequences))
    assert fill > 0.95


def test_packing_edges(spark):
    docs = odd_docs(spark)
    more = {"offset_note": packing.F.lit(1), "__group": packing.F.lit("g"), "Sequence_ID": packing.F.lit(5), "big": packing.F.when(packing.F.col("length") > 1, 2**60 + 1)}
    out = packing.pack(packing.tokenize(docs, tokenizer_path("word_bpe_49k.json")).withColumns(more), 11)
    rows = out.collect()
    assert sum(r["length"] == 1 for r in rows) >= 3 and all(r["offset_note"] == 1 and r["__group"] == "g" for r in rows)
    assert {r["big"] for r in rows} == {None, 2**60 + 1} and [c.lower() for c in out.columns].count("sequence_id") == 1
    same = spark.range(3000).select(packing.F.lit(None).cast("long").alias("doc_id"), packing.F.lit("one text").alias("text"))
    spread = packing.pack(packing.tokenize(same, tokenizer_path("word_bpe_49k.json")), 3000, group_size=150)
    assert len({r["sequence_id"] >> 32 for r in spread.collect()}) == 20  # rows without id don't share a group
    assert packing.pack(packing.tokenize(docs.filter("false"), tokenizer_path("word_bpe_49k.json")), 0).count() == 0


def brute_pieces(word, vocabulary):
    n = at = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary), 1)
        at += size
        n += 1
    return n


def test_piece_counter_is_greedy():
    rng = random.Random(3)
    for _ in range(300):
        vocabulary = {bytes(rng.choice(b"ab c") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 14))}
        counter = token_counts.PieceCounter(iter(sorted(vocabulary)))
        for _ in range(20):
            word = bytes(rng.choice(b"ab cd") for _ in range(rng.randint(0, 14)))
            assert counter.count(word) == brute_pieces(word, vocabulary), (vocabulary, word)


def test_token_counts_query(spark):
    vocabulary = set(token_counts.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken")))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.tiktoken")).collect():
        assert r["n_tokens"] == sum(brute_pieces(b" " + w.encode(), vocabulary) for w in texts[r["doc_id"]].split())
    got = token_counts.token_counts(odd_docs(spark), tokenizer_path("byte_bpe_50k.tiktoken")).collect()
    assert [r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)] == [0, 0, 0]


def test_transport_stream_round_trip():
    rng = random.Random(1)
    for size in [0, 1, 63, 64, 65, 183, 184, 4096, 4097, 40_000]:
        payload = media_ts.padded(rng.randbytes(size))
        stream = media_ts.mux(payload)
        got = media_ts.demux(stream)
        assert len(stream) % 188 == 0 and got.payload == payload and got.gaps == got.duplicates == 0
        assert got.programs == {1: {0x100: 6}} and [u.pts for u in got.units] == [3600 * k for k in range(len(got.units))]
        assert [u.key for u in got.units] == [k % 8 == 0 for k in range(len(got.units))]
    packets = [stream[k : k + 188] for k in range(0, len(stream), 188)]
    assert media_ts.demux(b"".join(packets[:5] + packets[4:])).duplicates == 1
    lost = media_ts.demux(b"".join(packets[:5] + packets[6:]))
    assert lost.gaps == 1 and sum(u.broken for u in lost.units) == 1
    assert media_ts.demux(b"\x00\x01" + stream).payload == payload
    assert media_ts.demux(b"").packets == 0


def test_sections_may_span_packets_and_clocks_are_read():
    payload = bytes(range(64)) * 2000
    stream = media_ts.mux(payload)
    packets = [stream[k : k + 188] for k in range(0, len(stream), 188)]
    body = b"".join((0xE000 | 0x100 + k).to_bytes(2, "big").join([b"\x06", b"\xf0\x00"]) for k in range(60))  # 60 streams: two packets
    section = media_ts._section(2, 1, (0xE000 | 0x100).to_bytes(2, "big") + b"\xf0\x00" + body)

    def packet(data, start, counter):
        return bytes([0x47, (0x40 if start else 0) | 0x10, 0x00, 0x10 | counter]) + data + b"\xff" * (184 - len(data))

    long_map = [packet(section[:184], True, 0), packet(section[184:], False, 1)]
    got = media_ts.demux(b"".join([packets[0], *long_map, *packets[2:]]))
    assert got.programs == {1: {0x100 + k: 6 for k in range(60)}} and got.payload == payload
    lost = media_ts.demux(b"".join([packets[0], long_map[0], packet(section[184:], False, 2), *packets[2:]]))
    assert lost.programs == {} and lost.gaps == 1
    assert got.clock == [3600 * 300 * 8 * k for k in range(len(got.clock))] and len(got.clock) == sum(u.key for u in got.units)


def test_media_query(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op6_media_columns"](spark, SF).collect():
        payload = media_ts.padded(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(docs[r["doc_id"]]), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    got = media_ts.probe(media_ts.store(odd_docs(spark))).collect()
    assert [r["payload_bytes"] for r in got][:3] == [64, 64, 64]


def test_other_columns_pass_untouched(spark):
    rows = [(2**60 + 1, "one two", None, [1, None]), (None, None, 2**55 + 1, None), (3, "", 5, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred long, __z array<int>")
    same = textops.filter_texts(docs, "text", lambda texts: [True] * len(texts))
    assert [tuple(r) for r in same.collect()] == rows and same.schema == docs.schema
    counted = token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.tiktoken"), keep=("doc_id", "lang_pred", "__z")).collect()
    assert [tuple(r)[:3] for r in counted] == [(r[0], r[2], r[3]) for r in rows]
    long = spark.createDataFrame([(k, "w" * 3_000_000) for k in range(5)], "doc_id long, text string")
    assert [r["n"] for r in textops.map_texts(long, "text", ["doc_id"], "n int", lambda texts: [[len(texts)] * len(texts)]).collect()] != [5] * 5
