"""The operators and the stages against brute force where a text is very long, where no row has an id, and end to end."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import audio, byte_bpe, common, lattice, mixture, neighbours, secrets, shards, simhash, similar, stages, token_ids
from lectern.llm.common import word_count

DOC_DDL = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))


def prose(seed, n, kinds=4000):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}w{rng.randrange(kinds)}" for _ in range(n))


def library():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(text, encoding):
    ids = encoding.encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


# --- log-mel -----------------------------------------------------------------------------------------------------------
def brute_log_mel(y):
    """Frame by frame, with the Fourier sums written out."""
    n = 1 + max(0, math.ceil((len(y) - audio.FRAME) / audio.HOP))
    t, k = np.arange(audio.FRAME), np.arange(audio.NFFT // 2 + 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / audio.FRAME)
    waves = np.exp(-2j * np.pi * np.outer(k, t) / audio.NFFT)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(audio.RATE / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    rows, levels = [], []
    for i in range(n):
        frame = np.zeros(audio.FRAME)
        part = y[i * audio.HOP : i * audio.HOP + audio.FRAME]
        frame[: len(part)] = part
        power = np.abs(waves @ (frame * window)) ** 2
        row = []
        for m in range(audio.MELS):
            a, b, c = edges[m : m + 3]
            row.append(math.log(1e-6 + sum(p * max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for p, f in zip(power, k * audio.RATE / audio.NFFT, strict=True))))
        rows.append(row)
        levels.append(10 * math.log10(1e-8 + float((frame**2).mean())))
    return np.array(rows), np.array(levels)


@pytest.mark.parametrize("n", [1, 399, 400, 401, 2500])
def test_log_mel_against_written_out_sums(n):
    y = (np.random.default_rng(n).standard_normal(n) * 0.2).astype(np.float32)
    rows, levels = audio.log_mel(y)
    want, want_levels = brute_log_mel(y)
    assert rows.shape == want.shape and np.allclose(rows, want, atol=2e-3) and np.allclose(levels, want_levels, atol=1e-3)


def test_blocks_of_frames_change_nothing(monkeypatch):
    y = np.random.default_rng(9).standard_normal(60_000).astype(np.float32)
    whole = audio.log_mel(y)
    monkeypatch.setattr(audio, "BLOCK", 7)
    again = audio.log_mel(y)
    assert (whole[0] == again[0]).all() and np.allclose(whole[1], again[1], atol=1e-9)


# --- lattice -------------------------------------------------------------------------------------------------------------
def test_language_model_score_against_plain_python(spark):
    """Both rounds of re-estimation and the documents' sums, over all segmentations one by one."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, start = lattice.vocabulary(path)
    place = {p: i for i, p in enumerate(pieces)}
    texts = ["the cat", "the cats then", "", None, "cat THE thing", "xyzzy the", "then"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    taught = [w for i, t in enumerate(texts) if i % 3 for w in lowered(t or "")]
    ends = sum(1 for i in range(len(texts)) if i % 3)

    def cuts(word):
        if not word:
            yield []
        for n in range(1, len(word) + 1):
            if word[:n] in place:
                for rest in cuts(word[n:]):
                    yield [place[word[:n]], *rest]

    def normal(counts):
        w = np.append(counts, ends) + lattice.PRIOR
        return w / w.sum()

    weight = normal(start / start.sum() * max(1, 3 * len(taught)))
    for _ in range(lattice.ROUNDS):
        expected = np.zeros(len(pieces))
        for word, times in Counter(taught).items():
            ways = [(math.prod(weight[i] for i in own), own) for own in cuts(b" " + word)]
            total = sum(p for p, _ in ways)
            for p, own in ways:
                for i in own:
                    expected[i] += times * p / total
        weight = normal(expected)
    chance = lambda word: sum(math.prod(weight[i] for i in own) for own in cuts(b" " + word))
    want = {i: sum(math.log10(chance(w)) for w in lowered(t or "")) + math.log10(weight[-1]) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["score"] for r in lattice.score(rows, path, F.col("doc_id") % 3 != 0).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 for i in want)
    again = {r["doc_id"]: r["score"] for r in lattice.score(rows.repartition(5), path, F.col("doc_id") % 3 != 0).collect()}
    assert again == got


# --- very long texts -------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(77)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    return prose(77, 400_000, 60_000) + " " + " ".join(hexa(40) for _ in range(2000)) + " größe 日本語 " + "q" * 20_000


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    rows = [(1, long_text), (2, "short one"), (3, long_text + " end"), (4, None), (5, long_text)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC_DDL).repartition(2).cache()


def test_long_texts_as_media(long_docs, long_text):
    got = {r["doc_id"]: r for r in audio.audio_features(long_docs).select("doc_id", "n_bytes", "payload_sha256", "n_frames").collect()}
    data = long_text.encode()
    padded = data + b"\xff" * (-len(data) % 576)
    assert got[1]["n_bytes"] == len(data) and got[1]["payload_sha256"] == hashlib.sha256(padded).hexdigest() and got[1]["n_frames"] > audio.BLOCK


def test_long_texts_as_token_files(spark, tmp_path, long_docs, long_text, monkeypatch):
    monkeypatch.setattr(token_ids, "MEMO_IDS", 200_000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(map(tuple, token_ids.read_token_files(token_ids.write_token_files(long_docs, f"file://{tmp_path}", path)).collect()))
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(path), 0
    for (doc, begin, n, crc), text in zip(got, [long_text, "short one", long_text + " end", "", long_text], strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, token_ids.END_ID]
        assert (begin, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), doc
        start += n


def test_long_texts_as_near_duplicates(long_docs, long_text):
    prints = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(long_docs).collect()}
    own = lowered(long_text)
    h = np.array([xxhash.xxh64_intdigest(b" ".join(own[i : i + 4]), 42) for i in range(len(own) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if int(((h >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(h))
    assert prints[1][0] % 2**64 == want and prints[3][1] == prints[5][1] == 1
    groups = dict(map(tuple, similar.near_duplicates(long_docs).collect()))
    assert groups == {1: 1, 2: 2, 3: 1, 4: 4, 5: 1}


def test_long_texts_of_the_other_operators(spark, long_docs, long_text):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    judged = {r["doc_id"]: r["score"] for r in neighbours.score(long_docs, neighbours.fit(long_docs, labels)).collect()}
    assert judged[1] == judged[5] and all(0 <= x <= 1 for x in judged.values())
    path = public_tokenizers.path("piece_bpe_32k.model")
    scored = {r["doc_id"]: r for r in lattice.score(long_docs, path, F.lit(True)).collect()}
    assert scored[1]["n_tokens"] == len(lowered(long_text)) + 1 and scored[1]["score"] == scored[5]["score"] < 0
    mixed = {r["doc_id"]: r["size"] for r in mixture.mix(long_docs, word_count(F.col("text"))).collect()}
    assert mixed[1] == len(lowered(long_text)) and mixed[4] == 0
    placed = shards.shard_by_bytes(long_docs.select("doc_id", "n_chars"), F.col("n_chars"), ["doc_id"]).collect()
    assert len(placed) == 5
    want = {i: digests(t, library()) for i, t in ((1, long_text), (2, "short one"))}
    got = {r["doc_id"]: tuple(r)[1:] for r in byte_bpe.digests(long_docs).collect()}
    assert got[1] == got[5] == want[1] and got[2] == want[2]


def test_many_secrets_in_one_text(spark):
    rng = random.Random(20)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    text = "é " + " ".join(hexa(rng.randint(30, 50)) for _ in range(20_000))
    rows = spark.createDataFrame([(1, text, "a"), (2, text[:5000], "b")], "doc_id long, text string, source string")
    began = time.monotonic()
    got = {r["doc_id"]: r["findings"] for r in secrets.scan(rows, keep=["doc_id"]).collect()}
    assert time.monotonic() - began < 60
    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{32,}", text)]
    assert [(f["start"], f["stop"]) for f in got[1] if f["kind"] == "hex"] == want and len(want) > 15_000


# --- no ids ------------------------------------------------------------------------------------------------------------------
def test_tables_without_ids(spark, tmp_path):
    texts = [prose(i, 30) for i in range(40)] + [None, "", prose(3, 30)]
    docs = spark.createDataFrame([(None, t, None, "s" if i % 2 else None, None) for i, t in enumerate(texts)], DOC_DDL).repartition(4)
    n = len(texts)
    assert audio.audio_features(docs).count() == n
    files = token_ids.write_token_files(docs, f"file://{tmp_path}", public_tokenizers.path("byte_bpe_50k.json"))
    assert token_ids.read_token_files(files).count() == n
    assert shards.shard_by_bytes(docs, F.length("text"), ["doc_id", "text"]).count() == n
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {None}
    assert neighbours.score(docs, neighbours.fit(docs, spark.createDataFrame([(None, 1)], "doc_id long, quality int"))).filter("score = 0.5").count() == n
    assert lattice.score(docs, public_tokenizers.path("piece_bpe_32k.model"), F.lit(False)).count() == n
    assert mixture.mix(docs, word_count(F.col("text"))).count() == n
    assert byte_bpe.digests(docs).count() == n and secrets.scan(docs).count() == n
    assert stages.near_duplicates(spark, docs, "").count() == n - 2  # a copy, and the null with the empty text


def test_files_of_equal_ids_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_ids, "FILE_BYTES", 2000)
    docs = spark.createDataFrame([(None, prose(i, 40)) for i in range(60)], "doc_id long, text string").repartition(3)
    files = token_ids.write_token_files(docs, f"file://{tmp_path}", public_tokenizers.path("byte_bpe_50k.json"))
    assert files.count() > 3 and files.agg(F.max("n_docs")).first()[0] < 30


# --- stages ------------------------------------------------------------------------------------------------------------------
def brute_similar_first(rows, similarity=0.8):
    """Of (doc_id, text) rows: what stays, one for each component of five-word similarity."""
    def grams(t):
        w = lowered(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    by = {}
    for k, (i, _) in enumerate(rows):
        by.setdefault(find(k), []).append((i is None, i or 0, k))
    return sorted(min(x)[2] for x in by.values())


def stage_rows():
    rng = random.Random(4)
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = []
    for i in range(30):
        rows.append((i, prose(i, 60 + i), "en", f"s{i % 4}", 0))
    for i in range(10):
        own = prose(i, 60 + i).split()
        own[20] = "changed"
        rows.append((100 + i, " ".join(own), "de", f"s{i % 3}", None))
    rows += [(200, "password = hunter2hunter2 " + prose(201, 40), "en", "s0", 1), (201, f"see {hexa} here " + prose(202, 40), "en", "s1", 1)]
    rows += [(210 + i, f"token: {hexa}{i} shared abcdefabcdefabcdefabcdefabcdef123456 " + prose(300 + i, 30), "en", f"s{i}", 1) for i in range(4)]
    rows += [(300, None, None, None, None), (301, "", "en", None, 0), (None, prose(400, 30), "en", "s1", 0), (7, prose(7, 67), "en", "s3", 0)]
    return rows + [rows[5], rows[5]]


def test_near_duplicate_stage_against_all_pairs(spark):
    rows = stage_rows()
    docs = spark.createDataFrame(rows, DOC_DDL)
    got = Counter(map(tuple, stages.near_duplicates(spark, docs.repartition(3), "").collect()))
    assert got == Counter(rows[k] for k in brute_similar_first([(r[0], r[1] or "") for r in rows]))
    clash = docs.withColumns({"hash_1_of_row_": F.lit(1), "ID_of_row_": F.lit("x"), "node": F.lit(2)})
    out = stages.near_duplicates(spark, clash, "")
    assert out.columns == clash.columns and out.count() == sum(got.values())


def test_stages_carry_columns_of_any_name(spark):
    rows = stage_rows()
    names = ["score", "held_out", "predicted", "findings", "size", "source_size", "target", "copies", "copy_", "node", "key0", "carried_column_5"]
    docs = spark.createDataFrame([(*r, *[f"{r[0]} {n}" for n in names]) for r in rows], DOC_DDL + "".join(f", {n} string" for n in names))
    labels = "/root/testdata/sf0.001"
    for stage in (stages.quality, stages.near_duplicates, stages.secret_scan, stages.mixing):
        out = stage(spark, docs, labels)
        assert out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert got and all(r[n] == f"{r['doc_id']} {n}" for r in got for n in names)
    assert stages.encode(spark, docs, labels).count() == len(rows)


@pytest.mark.parametrize("few", [0, 250_000])
def test_near_duplicate_stage_joins_alike_at_every_size(spark, monkeypatch, few):
    monkeypatch.setattr(similar, "BROADCAST_ROWS", few)
    rows = stage_rows()
    got = Counter(map(tuple, stages.near_duplicates(spark, spark.createDataFrame(rows, DOC_DDL), "").collect()))
    assert got == Counter(rows[k] for k in brute_similar_first([(r[0], r[1] or "") for r in rows]))


def test_secret_stage_against_plain_python(spark):
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in stage_rows()]
    kinds = [(re.compile(secrets.ASSIGN, re.ASCII), 2, 8), (re.compile("AKIA[A-Z0-9]{12,}"), 0, 16), (re.compile("[0-9a-f]{32,}"), 0, 32)]
    found = [[m.group(g) for p, g, least in kinds for m in p.finditer(r[1] or "") if len(m.group(g)) >= least] for r in rows]
    owners = {}
    for r, own in zip(rows, found, strict=True):
        for v in own:
            owners.setdefault(v, set()).add(r[3])
    want = Counter()
    for r, own in zip(rows, found, strict=True):
        text = r[1]
        for v in sorted({v for v in own if len(owners[v]) < 3 and len(set(v)) >= 5}, key=lambda v: (-len(v), v)):
            text = text.replace(v, "[REDACTED]")
        want[(r[0], text, r[2], r[3], None if text is None else len(text))] += 1
    got = stages.secret_scan(spark, spark.createDataFrame(rows, DOC_DDL), "")
    assert Counter(map(tuple, got.collect())) == want


def test_mixing_and_encoding_stages_against_plain_python(spark):
    rows = stage_rows()
    docs = spark.createDataFrame(rows, DOC_DDL)
    mixed = Counter(map(tuple, stages.mixing(spark, docs, "").collect()))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(lowered(r[1] or ""))
    once = Counter(rows)
    assert all(n <= 2 * once[r] for r, n in mixed.items())
    taken = Counter()
    for r, n in mixed.items():
        taken[r[3]] += n * len(lowered(r[1] or ""))
    targets = {r["source"]: r["target"] for r in mixture.source_targets(spark.createDataFrame([(r[3], len(lowered(r[1] or ""))) for r in rows], "source string, size long")).collect()}
    biggest = max(len(lowered(r[1] or "")) for r in rows)
    assert all(abs(taken[s] - targets[s]) <= biggest for s in sizes)
    encoding = library()
    got = Counter(map(tuple, stages.encode(spark, docs, "").collect()))
    assert got == Counter((r[0], *digests(r[1] or "", encoding)) for r in rows)


def test_pipeline_runs_its_stages_in_order(spark, tmp_path):
    rows = [r for r in stage_rows() if r[0] is not None]
    spark.createDataFrame(rows, DOC_DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100 or i >= 200), 0) for i in range(220)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "secret_scan", "mixing", "encode"]
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), "by-hand")
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, docs.collect()))


def test_spent_tables_are_removed(spark):
    with common.spent("kept_as-it is"):
        gone = common.written(spark.range(5), "gone")
        stays = common.written(spark.range(5), "kept_as-it is")
    assert stays.count() == 5
    with pytest.raises(Exception, match=r"(?i)exist|not found"):
        gone.count()
