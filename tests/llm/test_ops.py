"""The operators against brute force, on hard small tables: nulls, empty and long texts, ties, repeats, clashing names."""

import base64
import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import audio, byte_bpe, importance, lattice, linededup, mixture, neighbours, registry, secrets, shards, simhash, similar, spelling, stages, token_ids, topk, wordblocks
from lectern.llm.common import work_dir, word_count

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, Row long, part string, Block int, tile int, findings string, score string"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "Thing", "ein", "für", "größe,", "x.", "naïve", "\n", "is"]) + rng.choice(["", "", "s", "ly."]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with nulls in every column, repeats, ties, empty and long texts, other scripts, and columns that clash with helper names."""
    rng = random.Random(11)
    texts = [words(rng, rng.randint(1, 80)) for _ in range(60)]
    odd = [None, "", " ", "\n\n", "a", "two words", "three of them", "a  b\tc", " \x00 z", "日本語 テキスト", "emoji 😀 x", "<|endoftext|> y", "z" * 3000, words(rng, 6000), "it's we'll '", "½ ² Ⅷ"]
    rows = [(i, t, "en", f"src{i % 3}", len(t), i, "p", i, 0, "f", "s") for i, t in enumerate(texts)]
    rows += [(100 + i, t, None, None if i % 2 else "é", None, None, None, None, None, None, None) for i, t in enumerate(odd)]
    rows += [(200 + i, texts[0], "en", "src0", 1, 0, "p", 0, 0, "f", "s") for i in range(25)]  # copies
    rows += [(300 + i, texts[1] + f" tail{i}", "en", "src0", 1, 0, "p", 0, 0, "f", "s") for i in range(5)]
    rows += [rows[3], rows[3], (None, "no id here", "en", "src1", 3, 0, "p", 0, 0, "f", "s")]
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


def empty(docs):
    return docs.limit(0)


def bag(rows):
    return Counter(map(tuple, rows))


# --- 1 ---------------------------------------------------------------------------------------------------------------
def test_audio_round_trip_and_features(spark, docs, local):
    out = audio.audio_features(docs).collect()
    want = Counter()
    for i, t, _ in local:
        data = t.encode()
        pad = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        want[i, len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:])] += 1
    assert bag((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
    for r in out:
        with wave.open(io.BytesIO(bytes(r["media"]))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, r["payload_bytes"])
        table = audio.read_tensors(bytes(r["tensors"]))
        assert table["mel"].type == pa.fixed_shape_tensor(pa.float32(), (audio.PATCH, audio.MELS)) and table.num_rows == -(-r["n_frames"] // audio.PATCH)
        assert r["segments"] and all(0 <= s["start_s"] < s["end_s"] for s in r["segments"])
    same = {r["media"]: r["tensors"] for r in out}
    assert all(same[r["media"]] == r["tensors"] for r in out)
    assert audio.audio_features(empty(docs)).count() == 0
    stored = audio.store_features(audio.audio_features(docs)).collect()
    row = lambda r: (r["doc_id"], r["payload_sha256"], bytes(r["tensors"]), str(r["segments"]))
    assert Counter(map(row, stored)) == Counter(map(row, out)) and all(r["media_bytes"] == r["payload_bytes"] + 44 for r in stored)


def test_features_are_on_their_grid_in_any_order_of_sums():
    rng = np.random.default_rng(3)
    x = (rng.integers(0, 256, 5000) - 128) / 128
    y = audio.resample(x)
    assert (y * 128 * audio.TAP_GRID == np.rint(y * 128 * audio.TAP_GRID)).all()
    mel, _ = audio.log_mel(y)
    shuffled = rng.permutation(audio.NFFT // 2 + 1)
    bank = audio._mel_bank()
    frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([y, np.zeros(audio.FRAME)]), audio.FRAME)[:: audio.HOP][: len(mel)]
    power = np.abs(np.fft.rfft(frames * audio._window(), audio.NFFT)) ** 2
    other = np.rint(np.log(1e-6 + power[:, shuffled] @ bank[shuffled]) * audio.MEL_GRID) / audio.MEL_GRID
    assert (mel == other.astype(np.float32)).all()


def test_resampling_is_the_filter_of_the_zero_stuffed_signal():
    x = np.random.default_rng(1).standard_normal(301).astype(np.float32)
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    h = audio._filter().T.ravel()
    want = np.convolve(stuffed, h)[: len(stuffed) : audio.DOWN]
    assert np.allclose(audio.resample(x)[: len(want)], want, atol=1e-5)


def test_a_tone_keeps_its_pitch_and_aliases_are_cut():
    t = np.arange(audio.RATE_IN) / audio.RATE_IN
    peak = lambda hz: np.argmax(np.abs(np.fft.rfft(audio.resample(np.sin(2 * np.pi * hz * t).astype(np.float32)))))
    assert abs(peak(1000) - 1000) <= 1
    assert np.abs(audio.resample(np.sin(2 * np.pi * 11_000 * t).astype(np.float32))[100:-100]).max() < 0.2


def test_hysteresis_against_a_loop():
    level = np.random.default_rng(2).standard_normal(500).cumsum()
    quiet, loud = np.percentile(level, [10, 90])
    hi, lo = quiet + audio.ENTER * (loud - quiet), quiet + audio.LEAVE * (loud - quiet)
    on, want, start = False, [], 0
    for i, v in enumerate([*level, -1e9]):
        if not on and v >= hi:
            on, start = True, i
        elif on and v < lo:
            on = False
            want.append((start, i))
    assert audio.segments(level) == want and audio.segments(np.zeros(4)) == [(0, 4)]


# --- 2 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("n", "top"), [(0, 0), (1, 0), (1, 10**12), (1000, 50), (3000, 2**62), (2000, 10**6)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top + 1, n)).astype(np.uint64)
    e = token_ids.EliasFano.from_bytes(token_ids.EliasFano.of(v).to_bytes())
    for a, b in ((0, n), (0, min(n, 7)), (n // 3, n // 2), (max(0, n - 1), n)):
        assert (e.select(a, b) == v[a:b]).all()
    if n >= 1000:
        assert len(e.to_bytes()) * 8 <= n * (2.6 + max(0, math.log2(max(1, top / n)) + 1)) + 2000


def test_token_files_against_the_library(spark, docs, local):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = token_ids.write_token_files(docs, work_dir(spark, "t"), path)
    got = sorted(token_ids.read_token_files(manifest).collect(), key=lambda r: r["start"])
    at, want = 0, []
    for i, t, _ in sorted(local, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_ids.read_token_files(token_ids.write_token_files(empty(docs), work_dir(spark, "t"), path)).count() == 0


def test_pieces_against_the_library():
    rng = random.Random(3)
    letters = [*" \n.,'abz1_-<|é×ßœ\t", chr(0xA0), chr(0x2003), chr(0x3000), chr(0x85), "'s", " the", " a", "<|endoftext|>"]
    encoder = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for size in (14, len(letters)):
        texts = ["".join(rng.choice(letters[:size]) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
        ids, counts = encoder.encode([t.encode() for t in texts])
        at = np.concatenate([[0], np.cumsum(counts)])
        for k, t in enumerate(texts):
            assert encoder.tokenizer.encode(t, add_special_tokens=False).ids == ids[at[k] : at[k + 1]].tolist(), t


# --- 3 ---------------------------------------------------------------------------------------------------------------
def test_shards_are_contiguous_and_balanced(spark, docs):
    rows = docs.select("doc_id", "part", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size"))
    got = shards.shard_by_bytes(rows, F.col("size"), ["doc_id", "size"], 7).orderBy("shard", "slot").collect()
    assert bag((r["doc_id"], r["size"]) for r in got) == bag(tuple(r) for r in rows.select("doc_id", "size").collect())
    total, at, slots = sum(r["size"] for r in got), 0, Counter()
    for r in got:
        assert (r["shard"], r["slot"]) == (min(6, at * 7 // total), slots[r["shard"]])
        slots[r["shard"]] += 1
        at += r["size"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert shards.shard_by_bytes(empty(rows), F.col("size"), ["doc_id"]).count() == 0
    assert {(r["shard"]) for r in shards.shard_by_bytes(rows, F.lit(0), ["doc_id", "size"]).collect()} == {0}


# --- 4 ---------------------------------------------------------------------------------------------------------------
def brute_top(rows, step, top):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in fine if i % step == 0}):
        mine = [v for j, v in fine if j == i]
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for v in mine for j, w in fine if j != i and len(w) == len(v))
        out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [(2048, 512), (7, 3)])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block[0])
    monkeypatch.setattr(topk, "QUERIES", block[1])
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # ties beyond k
    rows += [(400, None), (None, rows[0][1]), (440, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (460, [float("nan")] * 6), (480, [float("inf")] * 6), (500, [3e5, -3e5, 0.0, 0.0, 0.0, 0.0]), (501, [-3e5, 1.5, 0.0, 0.0, 0.0, 0.0]), (501, [3e5, 2.5, 0.0, 0.0, 0.0, 0.0]), (520, [1.0, 2.0]), (540, [3.0, 1.0]), (560, []), (580, []), (20, [0.0] * 6)]
    v = topk.whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(v, v.filter("vec_id % 20 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 20, 5)
    none = v.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_top_k_of_large_components_and_repeated_ids(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(14)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(0, 60, 3)]  # other vectors of the same ids, queries among them
    rows += [(100 + i, [3e5 + i, 0.25, -1.0]) for i in range(25)]  # alike but for what lies beyond 2**24 after scaling
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted(map(tuple, topk.query(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(topk.ORACLE).fetchall())


def test_top_k_scores_up_to_a_long(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**10, 1.0]), (2, [2.0**10, 0.5]), (3, [-(2.0**10), 2.0]), (4, [0.0, 2.0**50])]
    v = topk.whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(v, v.filter("vec_id = 0"), 5)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 2**62 + 64 * 64), (0, 2, 2, 2**62 + 64 * 32), (0, 3, 4, 2**62), (0, 4, 3, -(2**62) + 64 * 128)]
    with pytest.raises(ValueError, match="does not fit"):
        topk._product(np.array([[2.0**40]]), np.array([[2.0**40]]), np.array([[True]]))
    assert topk._product(np.array([[2.0**40, 0.0]]), np.array([[0.0, 2.0**70]]), np.array([[True]])).tolist() == [[0]]


# --- 5 ---------------------------------------------------------------------------------------------------------------
def brute_print(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()))
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, distance=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark, docs, local):
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_print(t) for _, t, _ in local]
    roots = brute_components(prints)
    least = {}
    for (i, _, _), r in zip(local, roots, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = bag((i, p, least[r]) for (i, _, _), p, r in zip(local, prints, roots, strict=True))
    assert bag((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("hot", [1024, 16])
def test_links_of_planted_fingerprints(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    rng = random.Random(7)
    near = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    values = {rng.getrandbits(64) for _ in range(300)}
    for x in rng.sample(sorted(values), 60):
        values |= {near(x, rng.randint(1, 6)) for _ in range(3)}
    centre = rng.getrandbits(64)
    values |= {near(centre, rng.randint(0, 3)) for _ in range(150)}  # a dense group
    chain = rng.getrandbits(64)
    for _ in range(40):
        values.add(chain := near(chain, 4))
    values = sorted(values)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    tree = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")))
    root = {r["node"] % 2**64: r["root"] for r in tree.collect()}
    by = {}
    for x, r in zip(values, brute_components(values), strict=True):
        by.setdefault(r, set()).add(x)
    got = {}
    for x in values:
        got.setdefault(root.get(x, ("alone", x)), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by.values()))


@pytest.mark.parametrize(("many", "distance"), [(0, 4), (0, 3), (1 << 26, 2), (1 << 26, 6)])
def test_links_of_other_layouts(spark, monkeypatch, many, distance):
    monkeypatch.setattr(simhash, "MANY", many)
    fields = simhash.layout(distance, 200)
    assert sum(a + 1 for _, _, a, _ in fields) == distance + 1 or distance < len(fields) - 1
    assert sum(bits for _, bits, _, _ in fields) == 64 and all(c == 0 or 15 * c <= bits for _, bits, _, c in fields)
    rng = random.Random(many + distance)
    values = {rng.getrandbits(64) for _ in range(120)}
    for x in sorted(values)[:40]:
        values |= {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, distance + 2))) for _ in range(2)}
    values = sorted(values)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    root = {r["node"] % 2**64: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance)).collect()}
    by, got = {}, {}
    for x, r in zip(values, brute_components(values, distance), strict=True):
        by.setdefault(r, set()).add(x)
        got.setdefault(root.get(x, ("alone", x)), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by.values()))


def test_pairs_are_compared_once_whatever_the_batches():
    rng = np.random.default_rng(5)
    n = 300
    bucket, root = np.sort(rng.integers(0, 6, n)), rng.integers(0, 9, n)
    order = np.lexsort((root, bucket))
    root, prints = root[order], rng.integers(0, 4, n).astype(np.int64)
    cols = [bucket, np.zeros(n, np.int32), np.ones(n, bool), prints, np.arange(n), root]
    near = lambda i, j: bucket[i] == bucket[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= 1
    apart = {(i, j) for i, j in combinations(range(n), 2) if near(i, j) and root[i] != root[j]}
    first = {int(np.searchsorted(bucket, b)) for b in bucket}
    led = {(i, j) for i in first for j in range(i + 1, n) if near(i, j)}
    for size in (1, 7, 64, 300):
        for how, want in (("roots", apart), ("leaders", led)):
            found = []
            batches = (pa.RecordBatch.from_arrays([pa.array(c[at : at + size]) for c in cols], names=list("abcdef")) for at in range(0, n, size))
            for mine, other, _, held in simhash.by_key(batches, 1, 1, how):
                found += [tuple(sorted(p)) for p in zip(held[4][mine].tolist(), held[4][other].tolist(), strict=True)]
            assert len(found) == len(set(found)) and set(found) == want


def test_every_word_of_a_field_has_an_anchor_within_its_radius():
    masks = simhash._masks()
    words_ = np.arange(1 << 21, dtype=np.int64)
    syndrome = simhash._syndrome(words_ & 0x7FFF)
    for s, m in enumerate(masks):
        assert m[0].bit_count() <= 1 and len(m) == (22 if s == 0 else 14) and len(set(m.tolist())) == len(m)
        assert (simhash._syndrome((words_[syndrome == s][:200, None] ^ m) & 0x7FFF) == 0).all()


def brute_similar(texts, shingle, similarity):
    def grams(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()))
        return {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()

    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(texts))]


def test_pairs_of_the_similarity_share_an_anchor():
    for similarity, n in ((0.6, 10), (0.8, 10_000), (0.8, 10**9), (0.95, 10**6)):
        bits, fields, distance = similar.plan(similarity, n)
        differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
        assert (1 - (1 - differ) ** bits) ** fields <= similar.MISSED and 256 * differ < distance < 128
    assert similar.plan(1, 10)[1:] == (1, 0)
    places = similar._positions(14, 50)
    assert places.shape == (50, 14) and all(len(set(p)) == 14 for p in places.tolist())


def test_wide_fingerprints_differ_by_the_angle():
    rng = np.random.default_rng(2)
    for similarity in (0.5, 0.8, 0.9):
        differ = []
        for _ in range(40):
            h = rng.integers(0, 1 << 63, 800, np.uint64)
            both = round(400 * 2 * similarity / (1 + similarity))
            x, y = similar.wide_print(np.sort(h[:400])), similar.wide_print(np.sort(h[400 - both : 800 - both]))
            differ.append(int(np.bitwise_count(x ^ y).sum()) / 256)
        assert abs(np.mean(differ) - math.acos(2 * similarity / (1 + similarity)) / math.pi) < 0.015


def test_shared_sets_by_address(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, n, np.uint64)) for n in (1, 5, 300, 40)]
    files, places = {}, []
    for part in range(2):
        own = sets[2 * part : 2 * part + 2]
        (tmp_path / f"{part}.bin").write_bytes(b"".join(x.tobytes() for x in own))
        files[part] = f"file://{tmp_path}/{part}.bin"
        places += [part << similar.PLACE_BITS, part << similar.PLACE_BITS | len(own[0])]
    monkeypatch.setattr(similar, "HELD_BYTES", 100)
    monkeypatch.setattr(similar, "HELD_FILES", 1)
    held = similar.SharedSets(files)
    for k in (0, 3, 1, 2, 2, 0, 3):
        assert (held.at(places[k], len(sets[k])) == sets[k]).all()
    assert len(held.streams) == 1 and len(held.held) == 2
    assert similar.jaccard(np.array([1, 2, 3, 4], np.uint64), np.array([2, 3, 4, 5, 9], np.uint64)) == 0.5


@pytest.mark.parametrize("tile", [1 << 22, 200])
def test_links_among_many_near_misses(spark, monkeypatch, tile):
    """Families in which most pairs are just below the similarity: nothing may be given up unchecked."""
    monkeypatch.setattr(similar, "TILE_PAIRS", tile)
    rng = random.Random(8)
    texts = []
    for family in range(6):
        own = [f"f{family}w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(80):
            near = list(own)
            for i in rng.sample(range(200), 3):
                near[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(near))
    rng.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dict(map(tuple, similar.near_duplicates(rows).collect()))
    want = brute_similar(texts, 5, 0.8)
    missed = sum(got[i] != got[w] for i, w in enumerate(want))
    assert missed <= 3 and len(set(want)) > 150  # a link is missed with a chance of a few thousandths
    assert all(want[i] == want[g] for i, g in got.items())  # and none is made up


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rng = random.Random(9)
    one, two = (" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(2))
    rows = [(5, one), (None, one + " more"), (5, two), (7, two), (None, None), (9, ""), (7, two), (None, "alone")]
    df = spark.createDataFrame([(*r, "x", 1, "d") for r in rows], "doc_id long, text string, node string, size long, digest string")
    want = Counter([(5, 5), (None, 5), (5, 5), (7, 5), (7, 5), (None, 9), (9, 9), (None, None)])
    assert Counter(map(tuple, similar.near_duplicates(df).collect())) == want
    assert similar.near_duplicates(df.limit(0)).count() == 0
    keyed = similar.groups(df.filter("doc_id = 9"), ["node", "digest", "size"]).first()
    assert keyed.asDict(True) == {"node": "x", "digest": "d", "size": 1, "first": {"node": "x", "digest": "d", "size": 1}}


@pytest.mark.parametrize(("shingle", "similarity"), [(5, 0.8), (3, 0.6)])
def test_similar_texts_against_all_pairs(spark, shingle, similarity):
    rng = random.Random(5)
    plain = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [None, "", " \n", "a b", "A  b", "a b c"]
    for n in (12, 40, 150, 400):
        for _ in range(4):
            own = plain(n)
            for changed in (0, 1, 1, 2, 3, 4, 6, 8):
                near = list(own)
                for i in rng.sample(range(n), changed):
                    near[i] = f"x{rng.randrange(5000)}"
                texts.append(" ".join(near))
    chain = plain(100)
    for i in range(20):
        chain = [*chain[3:], *plain(3)]
        texts.append(" ".join(chain))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = dict(map(tuple, similar.near_duplicates(rows, shingle=shingle, similarity=similarity).collect()))
    assert [got[i] for i in range(len(texts))] == brute_similar([t or "" for t in texts], shingle, similarity)


def test_stage_drops_texts_of_five_word_similarity(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        own = [f"w{rng.randrange(5000)}" for _ in range(100)]
        texts += [" ".join(own), " ".join([*own[:50], "changed", *own[51:]])]  # 91 of 101 shingles
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in stages.near_duplicates(spark, rows, SF).collect()) == list(range(0, 24, 2))


# --- 6 ---------------------------------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = neighbours.score(d, neighbours.fit(d, labels))
    held = scored.filter("held_out").join(labels, "doc_id").toPandas()
    assert ((held["predicted"] == 1) == (held["quality"] == 1)).mean() > 0.97
    assert scored.select("text", "score").distinct().count() == scored.select("text").distinct().count()
    assert (held["held_out"] == held["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()


def test_quality_on_hard_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (5, None, 1), (7, 3, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    out = neighbours.score(docs, neighbours.fit(docs, labels)).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all() and ((out["predicted"] == 1) == (out["score"] >= 0.3)).all()
    none = neighbours.fit(docs, labels.limit(0))
    assert set(neighbours.score(docs, none).toPandas()["score"]) == {0.5}
    assert neighbours.score(empty(docs), neighbours.fit(empty(docs), labels)).count() == 0


def test_votes_against_plain_python(spark):
    texts = [words(random.Random(i), 30) for i in range(40)]
    x = np.stack([neighbours.terms(t) for t in texts])
    labels = np.arange(40) % 2
    model = neighbours.Model(np.ones(neighbours.N_TERMS), x, labels)
    for t, got in zip(texts[:10], model.scores(texts[:10]), strict=True):
        v = (neighbours.terms(t) * model.idf) @ model.axes
        cos = model.known @ (v / np.linalg.norm(v))
        near = np.argsort(-cos)[: neighbours.NEAREST]
        w = np.maximum(cos[near], 1e-6).astype(float) ** neighbours.POWER
        assert abs(got - (w * labels[near]).sum() / w.sum()) < 1e-3


def test_scores_do_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.001"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")

    def scored(n):
        x = d.repartition(n)
        return {r["doc_id"]: r["score"] for r in neighbours.score(x, neighbours.fit(x, labels)).select("doc_id", "score").collect()}

    assert scored(2) == scored(7)


def test_fit_and_projection_against_brute_force(spark):
    """Of fewer documents than axes the latent space is their span, so cosines are those of the weighted terms."""
    texts = [words(random.Random(i), 25) + (" !!" * i if i % 2 else "") for i in range(24)] + ["", "x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = neighbours.fit(docs, labels)
    x = np.stack([neighbours.terms(t) for t in texts]).astype(float)
    df = (x > 0).sum(axis=0)
    assert np.allclose(model.idf, np.log1p(len(texts) / (1 + df)))
    taught = sorted((i for i in range(20) if zlib.crc32(str(i).encode()) % 5), key=str)
    assert model.labels.tolist() == [i % 2 for i in taught]
    w = x[taught] * model.idf
    unit = w / np.linalg.norm(w, axis=1, keepdims=True)
    assert np.allclose(model.known @ model.known.T, unit @ unit.T, atol=2e-3)
    grams = Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2))
    counted = Counter()
    for t in texts:
        own = neighbours._grams(t)
        assert own.sum() == max(0, len(t) - 2) and own.tolist() == sum((neighbours._grams(t[i : i + 3]) for i in range(len(t) - 2)), np.zeros(neighbours.N_GRAMS, int)).tolist()
        counted.update(t[i : i + 3] for i in range(len(t) - 2))
    assert counted == grams
    back = neighbours.terms("a b a a c b")[-neighbours.N_BACK :] ** 2 * 10
    assert np.allclose(back[:5], [3, 1, 1, 1, 0])


def test_long_texts_are_cut_into_slices_without_loss(monkeypatch):
    text = words(random.Random(1), 400)
    whole = neighbours._grams(text)
    monkeypatch.setattr(neighbours, "SLICE", 37)
    assert (neighbours._grams(text) == whole).all()


def test_empty_text_gets_the_plain_share_of_the_sample():
    texts = [words(random.Random(i), 30) for i in range(30)]
    model = neighbours.Model(np.ones(neighbours.N_TERMS), np.stack([neighbours.terms(t) for t in texts]), np.arange(30) % 3 == 0)
    assert abs(model.scores([""])[0] - 1 / 3) < 1e-12


# --- 7 ---------------------------------------------------------------------------------------------------------------
def test_lattice_against_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, start = lattice.vocabulary(path)
    weight = np.log(start / start.sum())
    by = dict(zip(pieces, weight, strict=True))
    own = [b"thing", b"of", b"x", "größe".encode(), b"zzzzz", b"anderen"]

    def total(rest):
        return 1.0 if not rest else sum(math.exp(by[rest[:n]]) * total(rest[n:]) for n in range(1, len(rest) + 1) if rest[:n] in by)

    for w, got in zip(own, lattice.word_scores(own, weight, path), strict=True):
        assert abs(got - math.log(total(b" " + w))) < 1e-9
    expected = lattice.expected_counts(own, np.ones(len(own)), weight, path)
    length = np.array([len(p) for p in pieces])
    assert abs((expected * length).sum() - sum(len(w) + 1 for w in own)) < 1e-6


def test_long_words_by_stretches(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    weight = np.log(lattice.vocabulary(path)[1] / lattice.vocabulary(path)[1].sum())
    own = ["größenordnung".encode() * 9, b"z" * 700, b"x"]
    whole, counts = lattice.word_scores(own, weight, path), lattice.expected_counts(own, np.ones(3), weight, path)
    monkeypatch.setattr(lattice, "LONG", 50)
    assert np.allclose(lattice.word_scores(own, weight, path), whole)
    assert abs(lattice.expected_counts(own, np.ones(3), weight, path).sum() / counts.sum() - 1) < 0.05


def test_pieces_across_the_cuts_of_long_words_are_counted(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    weight = np.log(lattice.vocabulary(path)[1] / lattice.vocabulary(path)[1].sum())
    own = ["größenordnung".encode() * 9, b"information" * 40, b"z" * 151, b"x" * 49, b"x" * 50, b"thing"]
    whole = lattice.expected_counts(own, np.array([1, 2, 3, 1, 1, 4]), weight, path)
    for long in (50, 64):
        monkeypatch.setattr(lattice, "LONG", long)
        assert np.allclose(lattice.expected_counts(own, np.array([1, 2, 3, 1, 1, 4]), weight, path), whole)


def test_language_model(spark, docs, local):
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(False))
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lattice.score(docs, path, train).collect()
    tokens = [(i, bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()).split()) for i, t, _ in local]
    taught = [w for i, w in tokens if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = Counter(x for w in taught for x in w)
    n, v, ends = sum(c.values()) + len(taught), len(c) + 1, len(taught)
    p = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter((i, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(sum(p(c[x]) for x in w) + p(ends), 6)) for i, w in tokens)
    assert bag((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lattice.score(empty(docs), path, train).count() == 0
    nothing = lattice.score(docs, path, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-9 for r in nothing)


# --- 8 ---------------------------------------------------------------------------------------------------------------
def test_pivot_keeps_mass_and_expectation():
    rng = random.Random(8)
    for _ in range(300):
        p, q, v, w = rng.random(), rng.random(), rng.randint(1, 90), rng.randint(1, 90)
        if not (0 < p < 1 and 0 < q < 1):
            continue
        to_first, to_second = min((1 - p) * v, q * w), min(p * v, (1 - q) * w)
        chance = to_second / (to_first + to_second)
        a, b = mixture.pivot(p, v, q, w, chance * 0.5), mixture.pivot(p, v, q, w, chance + (1 - chance) * 0.5)
        for x, y in (a, b):
            assert abs(x * v + y * w - p * v - q * w) < 1e-6 and (x in (0, 1) or y in (0, 1))
        assert abs(chance * a[0] + (1 - chance) * b[0] - p) < 1e-9


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, total = {}, 1.5 * sum(sizes.values())
    while True:
        left = [s for s in order if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s: 2.0 * sizes[s] for s in left if share[s] > 2 * sizes[s]}
        if not over:
            return full | share
        full |= over


def test_mixture(spark, docs, local, monkeypatch):
    monkeypatch.setattr(mixture, "GROUP", 5)
    monkeypatch.setattr(mixture, "FAN_IN", 2)
    out = mixture.mix(docs, word_count(F.col("text")))
    rows = out.collect()
    assert set(docs.columns) <= set(out.columns) and len(rows) == len(local)
    sizes = Counter()
    for _, t, s in local:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want, taken, biggest = plain_targets(sizes), Counter(), Counter()
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["copies"] <= 2
        assert r["copies"] in (math.floor(want[s] / sizes[s]), math.floor(want[s] / sizes[s]) + 1)
        taken[s] += r["copies"] * r["size"]
        biggest[s] = max(biggest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= biggest[s] for s in sizes)
    again = mixture.mix(docs.repartition(2), word_count(F.col("text")))
    key = ["doc_id", "size", "copies"]
    assert bag(out.select(key).collect()) == bag(again.select(key).collect())
    assert mixture.mix(empty(docs), word_count(F.col("text"))).count() == 0
    assert {r["copies"] for r in mixture.mix(docs, F.lit(None).cast("long")).collect()} == {0}


# --- 9 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [8 << 20, 300])
def test_byte_bpe_against_the_library(spark, docs, local, monkeypatch, block):
    import tiktoken

    monkeypatch.setattr(wordblocks, "BLOCK_BYTES", block)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    got = byte_bpe.decode(encoded, path).collect()
    want = Counter((i, np.array(library.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t, _ in local)
    assert bag((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert byte_bpe.digests(empty(docs)).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert byte_bpe.decode(nulls, path).first()["decoded"] is None


def test_packed_arrays():
    a, b = np.arange(1000, dtype=np.uint32), np.empty(0, np.int64)
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(wordblocks.unpack(wordblocks.pack(a, b, a.astype(np.uint8))), (a, b, a.astype(np.uint8)), strict=True))
    w, (c,) = wordblocks.unpack_words(wordblocks.pack_words([b"a", b"", "é".encode()], np.array([3, 0, 1])))
    assert w == [b"a", b"", "é".encode()] and c.tolist() == [3, 0, 1]


# --- 10 --------------------------------------------------------------------------------------------------------------
BASE = [("assign", re.compile(secrets.ASSIGN, re.ASCII), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def brute_secrets(rows):
    found, owners = [], {}
    for _, t, s in rows:
        own = []
        for k, (_, p, g, least) in enumerate(BASE):
            own += [(m.start(), k, m.end(), m.group(g)) for m in p.finditer(t) if len(m.group(0 if g == 0 else g)) >= least]
        found.append(sorted(own))
        for *_, v in own:
            owners.setdefault(v, set()).add(s)
    out = []
    for (i, _, _), own in zip(rows, found, strict=True):
        more = {(z - len(v), 4 if len(owners[v]) >= 3 else 3, z) for _, _, z, v in own if len(owners[v]) >= 3 or len(set(v)) >= 5}
        name = [*[b[0] for b in BASE], "live", "example"]
        text = lambda spans: ",".join(f"{name[k]}:{a}:{z}" for a, k, z in spans)
        base = [(a, k, z) for a, k, z, _ in own]
        out.append((i, text(base), text(sorted(base + list(more)))))
    return Counter(out)


def test_ownership_of_secrets(spark):
    spread, kept, common = "0123456789abcdef" * 2, "fedcba9876543210" * 2, "00112233445566778899aabbccddeeff"
    rows = [(i, f"a {spread} b {spread}", "x") for i in range(5)] + [(5, kept, None), (5, kept, None), (None, common, "y"), (None, common, "y")] + [(6 + i, common, f"o{i}") for i in range(3)]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=["doc_id"]).collect()
    got = {(r["doc_id"], f["kind"], f["owners"], f["repositories"]) for r in found for f in r["findings"]}
    judged = {(i, "live", 1, 5) for i in range(5)} | {(5, "live", 1, 1), (None, "example", 4, 4)} | {(6 + i, "example", 4, 4) for i in range(3)}
    assert got == judged | {(r[0], "hex", None, None) for r in rows}


def test_secrets(spark, docs, local):
    rng = random.Random(10)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    shared, own, key = hexa(40), hexa(36), "AKIA" + "ABCDEFGHIJKLMNOP"
    made = [
        f'token = "{shared}"', f"x {shared} 😀 password={own} y", f"API_KEY: '{own}'", f"secret:token:abcdefgh1 {key}", "token=token=abcdefghijk", "passwd = short", "AKIASHORT AKIA",
        f"g{shared}", "password:secret:abcdefgh1", hexa(31) + " " + "0" * 40, f"Token=\"{shared}\" and {key}", "apikey=aaaaaaaaaa", f"{hexa(32)}{own}", "api_key  =  'x+/_.=-12345'", "é" * 9 + f" secret={hexa(20)}",
    ]
    extra = [(500 + i, t, "en", [f"o{i % 5}", None][i % 7 == 6], 1, 0, "p", 0, 0, "f", "s") for i, t in enumerate(made)]
    table = docs.unionByName(spark.createDataFrame(extra + [extra[0]], DDL))
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in table.collect()]
    joined = secrets._joined
    got = secrets.scan(table, keep=["doc_id"]).select("doc_id", joined(F.filter("findings", lambda s: ~s["kind"].isin(*secrets.VERDICTS))).alias("b"), joined(F.col("findings")).alias("s")).collect()
    assert bag(got) == brute_secrets(rows)
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(table).collect()}
    assert own not in "".join(filter(None, clean.values())) and shared in clean[500] and clean[0] == dict((i, t) for i, t, _ in rows)[0]
    assert secrets.redacted(table).columns == table.columns and secrets.scan(empty(docs)).count() == 0


# --- registry and stages -----------------------------------------------------------------------------------------------
def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_stages(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = stages.near_duplicates(spark, plain, SF).collect()
    comps = simhash.near_duplicates(plain).select("component_id").distinct().count()
    assert len(kept) == comps and {r["doc_id"] for r in kept} >= {0, 2}
    mixed = stages.mixing(spark, plain, SF)
    taken = mixture.mix(plain, word_count(F.col("text"))).agg(F.sum("copies")).first()[0]
    assert mixed.columns == plain.columns and mixed.count() == taken
    assert stages.secret_scan(spark, plain, SF).columns == plain.columns
    none = plain.limit(0)
    for stage in (stages.near_duplicates, stages.secret_scan, stages.mixing, stages.encode, stages.quality):
        assert stage(spark, none, SF).count() == 0


def test_pipeline_end_to_end(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    first = stages.quality(spark, d, SF).toPandas()
    judged = first[first["doc_id"].isin(labels)]
    assert judged["doc_id"].map(labels).mean() > 0.95 and len(judged) > 0.9 * sum(labels.values())
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out["doc_id"]) <= set(first["doc_id"]) and (out.groupby("doc_id").size() <= 2).all()
    assert isinstance(out, pd.DataFrame) and list(out.columns) == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


# --- 11 --------------------------------------------------------------------------------------------------------------


def brute_words(rows, one_in):
    n = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, ratio=2):
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def test_spelling_variants_against_brute_force(docs, local):
    for one_in in (None, 3, 97):
        got = spelling.spelling_variants(docs, one_in=one_in)
        assert bag(got.collect()) == brute_variants(brute_words(local, one_in))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.schema == spelling.spelling_variants(empty(docs)).schema
    assert spelling.spelling_variants(empty(docs)).count() == 0


def test_spelling_chains_ties_and_repeated_letters(spark):
    rng = random.Random(5)
    n = {"aaaaa": 1000, "aaaab": 400, "aaabb": 150, "aabbb": 60, "abbbb": 25, "bbbbb": 7, "aaaa": 8, "aaaaaa": 3, "größe": 9, "grösse": 4, "größen": 9, "gröben": 2, "naïve": 5, "naive": 10, "nàive": 10, "zzzzz": 3}
    for _ in range(300):
        n["".join(rng.choice("abcé") for _ in range(rng.randint(4, 7)))] = rng.randint(1, 50)
    rows = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    assert bag(spelling.group_variants(rows).collect()) == brute_variants(n)


def test_spelling_words_of_long_texts_are_whole(monkeypatch):
    text = "Straße " * 50 + "x" * 300 + " Éaİb " + "Ünder-way" * 40
    want = Counter(w for part in spelling.text_words(text) for w in part)
    monkeypatch.setattr(spelling, "WINDOW", 7)
    assert Counter(w for part in spelling.text_words(text) for w in part) == want
    assert want["x" * 300] == 1 and want["straße"] == 50 and want["Éa"] == 1


# --- 12 --------------------------------------------------------------------------------------------------------------


def brute_resampled(rows, target, longest=1, buckets=10_000, seed=2024, min_words=20, percent=10):
    def features(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
        return [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)

    def totals(texts):
        return Counter(zlib.crc32(f) % buckets for x in texts for f in features(x)[0])

    s, t = totals(x for _, x, _ in rows), totals(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for doc_id, text, _ in rows:
        own, n_words = features(text)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in own)
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    rest = able[len(drawn) :] + [r for r in out if r[4] < min_words]
    return Counter([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in rest])


def test_importance_resampling_against_brute_force(spark, docs, local):
    target = ["the thing", "größe thing thing THE", None, "", "ein 42 für"]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    for more in ({}, {"longest": 3, "buckets": 64, "seed": 7, "min_words": 2, "percent": 55}, {"percent": 100, "min_words": 0}):
        got = importance.resample(docs, frame, **more)
        assert bag(got.collect()) == brute_resampled(local, [t or "" for t in target], **more)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert importance.resample(empty(docs), frame).count() == 0
    assert bag(importance.resample(docs, frame.limit(0)).collect()) == brute_resampled(local, [])


def test_importance_features_of_long_texts_are_whole(monkeypatch):
    text = "Ab, cd 42 éÉ-x y ß " * 40
    want = importance.features(text, 3, 1000)
    monkeypatch.setattr(importance, "WINDOW", 5)
    got = importance.features(text, 3, 1000)
    assert got[:2] == want[:2] and all((a == b).all() for a, b in zip(got[2:], want[2:], strict=True))


# --- 13 --------------------------------------------------------------------------------------------------------------


def brute_lines(rows, least=10, length=1):
    key = lambda x: "".join(c.lower() if c < "\x7f" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    split = {(i, t): t.split("\n") for i, t, _ in rows}
    seen = Counter(k for lines in split.values() for k in {key(x) for x in lines})
    common = {k for k, n in seen.items() if n >= least and len(k) >= length}
    out = Counter()
    for i, t, _ in rows:
        left = [x for x in split[i, t] if key(x) not in common]
        out[i, len(split[i, t]), len(split[i, t]) - len(left), "\n".join(left)] += 1
    return out


@pytest.fixture(scope="module")
def line_docs(spark, docs):
    rng = random.Random(3)
    pool = ["Home | About", " home | about\t", "©  Ünder", "Same line", "", " ", "x", "\x0b\x0c", "ÀB", "àb", "İ", "K"]
    rows = [(1000 + i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {i} {j}" for j in range(rng.randint(1, 40))), "en", "src0", 1, 0, "p", 0, 0, "f", "s") for i in range(60)]
    rows += [(2000 + i, "\n".join(["Same line"] * 300), "en", None, 1, 0, "p", 0, 0, "f", "s") for i in range(12)]
    rows += [(None, "Same line\nHome | About", None, None, 1, 0, "p", 0, 0, "f", "s")] * 2 + [rows[0]] * 9 + [(3000, "rare\nSame line", "en", "src0", 1, 0, "p", 0, 0, "f", "s")] * 15
    return docs.unionAll(spark.createDataFrame(rows, DDL)).repartition(4).cache()


def test_line_dedup_against_brute_force(line_docs):
    local = [(r["doc_id"], r["text"] or "", None) for r in line_docs.collect()]
    for least, length in ((10, 1), (2, 0), (3, 5)):
        got = linededup.dedup_lines(line_docs.withColumns({"keep_bitmap": F.lit("mine"), "h1": F.lit(1), "id": F.lit(2), "key": F.lit(3)}), min_documents=least, min_length=length)
        assert got.columns == [*line_docs.columns, "h1", "id", "key", "n_lines", "n_dropped", "keep_bitmap"]
        rows = got.select("doc_id", "n_lines", "n_dropped", linededup.kept_text(F.col("text"), F.col("keep_bitmap")))
        assert bag(rows.collect()) == brute_lines(local, least, length)
    assert linededup.dedup_lines(empty(line_docs)).count() == 0


def test_line_dedup_bitmaps(spark):
    rows = [(1, "a\nb\na\nc"), (2, "A \nd\nb"), (3, None), (4, "e"), (None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda **more: {r["id"]: (r["n_dropped"], r["keep_bitmap"]) for r in linededup.keep_bitmaps(df, min_documents=2, **more).collect()}
    assert of() == {1: (4, [0, 4]), 2: (2, [0, 1, 1, 1]), None: (1, [0, 1])}
    assert of(keep_first=True) == {1: (2, [2, 2]), 2: (2, [0, 1, 1, 1])}  # of "c" the row without an id comes first


def test_line_dedup_runs_without_python_and_with_one_shuffle_to_the_hashes(line_docs):
    plan = linededup.dedup_lines(line_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_of_a_very_long_text(spark):
    text = "\n".join("every second" if i % 2 else f"own {i}" for i in range(200_000))
    df = spark.createDataFrame([(i, text if i == 0 else "every second") for i in range(10)], "doc_id long, text string")
    got = linededup.dedup_lines(df).filter("doc_id = 0").select("n_lines", "n_dropped", F.length(linededup.kept_text(F.col("text"), F.col("keep_bitmap")))).first()
    assert tuple(got) == (200_000, 100_000, sum(len(f"own {i}") + 1 for i in range(0, 200_000, 2)) - 1)


def test_similar_texts_meet_at_anchors_of_a_covering_code():
    """A home within radius 1, replicas within radius plus threshold: words of a field that differ in one bit meet at both their homes."""
    for similarity, n in ((0.6, 10), (0.8, 10_000), (0.8, 10**7)):
        bits, fields, _ = similar.covering(similarity, n)
        differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
        assert bits >= 15 and (1 - (1 - differ) ** bits - bits * differ * (1 - differ) ** (bits - 1)) ** fields <= similar.MISSED
    rng = np.random.default_rng(4)
    places = similar._positions(17, 5)
    base = rng.integers(0, 1 << 63, (40, similar.WORDS)).astype(np.uint64)
    near = base.copy()
    near[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
    prints = np.concatenate([base, near]).view(np.int64)
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in np.ascontiguousarray(prints.T)), *(pa.array(np.arange(80)) for _ in similar.CARRIED)], names=[*similar.PRINTS, *similar.CARRIED])
    at, homes = {}, {}
    for out in similar._anchors(places, False)([batch]):
        for bucket, home, node in zip(*(out.column(c).to_pylist() for c in ("bucket", "home", "node")), strict=True):
            at.setdefault((node, bucket >> 32), set()).add(bucket)
            if home:
                assert homes.setdefault((node, bucket >> 32), bucket) == bucket
    assert len(homes) == 80 * 5 and all(h in at[k] for k, h in homes.items())
    assert all(homes[i, k] in at[i + 40, k] and homes[i + 40, k] in at[i, k] for i in range(40) for k in range(5))
    alone = pa.Table.from_batches(similar._anchors(places, True)([batch]))
    assert dict(zip(zip(alone["node"].to_pylist(), [b >> 32 for b in alone["bucket"].to_pylist()], strict=True), alone["bucket"].to_pylist(), strict=True)) == homes


def test_homes_are_compared_once_with_rows_of_other_roots_whatever_the_batches():
    rng = np.random.default_rng(6)
    n = 300
    bucket, root, home = rng.integers(0, 6, n), rng.integers(0, 9, n), rng.random(n) < 0.3
    order = np.lexsort((root, ~home, bucket))
    bucket, root, home, prints = bucket[order], root[order], home[order], rng.integers(0, 4, n).astype(np.int64)
    cols = [bucket, np.zeros(n, np.int32), home, prints, np.arange(n), root]
    near = lambda i, j: bucket[i] == bucket[j] and root[i] != root[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= 1
    want = {(i, j) for i, j in combinations(range(n), 2) if (home[i] or home[j]) and near(i, j)}
    for size in (1, 7, 64, 300):
        found = []
        batches = (pa.RecordBatch.from_arrays([pa.array(c[at : at + size]) for c in cols], names=list("abcdef")) for at in range(0, n, size))
        for mine, other, _, held in simhash.by_key(batches, 1, 1, "roots"):
            found += [tuple(sorted(p)) for p in zip(held[4][mine].tolist(), held[4][other].tolist(), strict=True)]
            assert held[2][mine].all()
        assert len(found) == len(set(found)) and set(found) == want
