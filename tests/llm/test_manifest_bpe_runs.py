"""Merkle manifest, byte-level BPE and periodic runs against brute force; odd rows of each."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quire.llm import byte_bpe, merkle, periodic, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
KIND = "doc_id long, source string, lang string, n_chars long, text string, leaf string, place long, path string, grp int, words array<string>, runs int"


def documents(spark, rows):
    """Rows of (doc_id, source, text) among columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, s, "en", None if t is None else len(t), t, "x", 7, "y", 3, ["z"], 1) for i, s, t in rows], KIND)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(leaves, fan):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def steps(levels, i, fan):
    for level in levels[:-1]:
        first = i // fan * fan
        yield level[first:i], level[i + 1 : first + fan]
        i //= fan


def manifest(rows, fan=16):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified), one group after another."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in groups[s]], fan)
    top = tree([trees[s][-1][0] for s in order], fan)
    out = []
    for n, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(groups[s]):
            path = [*steps(trees[s], i, fan), *steps(top, n, fan)]
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            h = leaf_of(r, r["text"].translate(LOWER) if changed and r["text"] is not None else r["text"])
            for a, b in path:
                h = H(*a, h, *b)
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], H(*(x for a, b in path for x in a + b)), h, h == top[-1][0]))
    return sorted(out, key=str)


def proved(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in rows), key=str)


def test_manifest(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 7, rng.choice(["hot", "hot", "hot", "b", "ß", "", None]), rng.choice(["Some Text", "lower", "", None, "É a"])) for i in range(700)]
    rows += [(5, "one", "Alone"), (70, "hot", "again"), (70, "hot", "Again"), (70, "hot", "Again"), (None, "hot", "no id"), (None, None, None), (9, "Z" * 300, "x" * 50_000)]
    frame = documents(spark, rows)
    assert proved(spark, frame, tmp_path) == manifest([r.asDict() for r in frame.collect()])


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_small_manifests(spark, tmp_path, n):
    frame = documents(spark, [(i, "s", f"T{i}") for i in range(n)])
    assert proved(spark, frame, tmp_path) == manifest([r.asDict() for r in frame.collect()])


def test_manifest_levels_and_blocks(spark, monkeypatch):
    """Many levels of two, and so small blocks that every upper run is listed for several."""
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(f"g{i % 3}", i, H(str(i))) for i in range(90)]
    made = merkle.build(spark.createDataFrame(rows, "g string, i long, leaf string"), group="g", order=["i"], keep=["i"], fan=2)
    groups = [tree([leaf for g, _, leaf in rows if g == name], 2) for name in ("g0", "g1", "g2")]
    top = tree([t[-1][0] for t in groups], 2)
    assert made.root == top[-1][0]
    for r in merkle.proofs(made).collect():
        path = [*steps(groups[r.i % 3], r.i // 3, 2), *steps(top, r.i % 3, 2)]
        assert r.siblings == "".join(x for a, b in path for x in a + b) and r.subroot == groups[r.i % 3][-1][0]
    again = merkle.paths(made).select(merkle.folded(F.col("path"), F.col("leaf")).alias("r")).distinct().collect()
    assert [r.r for r in again] == [made.root]


def test_bpe(spark):
    rng = random.Random(3)
    parts = ["a", "b", " ", "the", "ing", "\n", "é", "ß", "1", "23", "!", " ", "  ", " ", "中", "😀", "'s", "'ll", "\t", "\x1c", "\x85", "²", "\U00010940", "\U0001e5d0", "\U00011de0", "́", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 150))) for _ in range(250)]
    texts += ["a" * 30_000, "ab" * 9000, " " * 9000 + "x", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000)), "=-" * 900, None, "", texts[0]]
    rows = [*enumerate(texts), (None, "no id"), (0, "another")]
    docs = documents(spark, [(i, "s", t) for i, t in rows])
    ranks = byte_bpe.Ranks(RANKS).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
    for batch, most in ((byte_bpe.BATCH, byte_bpe.WORDS), (2000, 100)):  # many batches, and tasks that begin anew
        coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, forms=("ids", "packed", "decoded"), batch=batch, most=most).collect()
        assert sorted(((r.doc_id, r.ids) for r in coded), key=str) == want
        assert all(bytes(r.packed) == np.array(r.ids, dtype="<u4").tobytes() for r in coded)
        assert sorted(bytes(r.decoded) for r in coded) == sorted((t or "").encode() for _, t in rows)
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    ids = spark.createDataFrame([(1, [15496, 995]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(ids, RANKS).collect()} == {1: library.decode_bytes([15496, 995]), 2: b"", 3: b""}


def test_parts_of_words_are_found_by_a_trie(spark, monkeypatch):
    """Spark folds only merges whose tokens lie in a word, and looks up no part of it."""
    rng = random.Random(11)
    merges = byte_bpe.Ranks(RANKS)
    parts = byte_bpe.Parts(merges.ranks)
    words = ["".join(rng.choice(["a", "er", "tion", " the", "é", "中", "=", " "]) for _ in range(rng.randint(1, 9))).encode() for _ in range(300)] + [b"=" * 400, b"q", b" the"]
    want = [sorted({merges.ranks[w[i:j]] for i in range(len(w)) for j in range(i + 2, len(w) + 1) if w[i:j] in merges.ranks}) for w in words]
    for places in (byte_bpe.PLACES, 7):  # words across several runs of places
        monkeypatch.setattr(byte_bpe, "PLACES", places)
        ranks, many = parts.find(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum([len(w) for w in words]))
        assert [x.tolist() for x in np.split(ranks, np.cumsum(many)[:-1])] == want
    ranks, many = parts.find(np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64))
    assert len(ranks) == len(many) == 0
    plan = byte_bpe.encode(documents(spark, [(1, "s", "a")]), RANKS, public_tokenizers.PATTERN)._jdf.queryExecution().optimizedPlan().numberedTreeString()
    assert "aggregate(" in plan and not any(f in plan for f in ("xxhash64(", "substr", "element_at("))


def test_words_of_every_character():
    find = byte_bpe.Words(public_tokenizers.PATTERN).finder()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.Ranks(RANKS).ranks, special_tokens={})
    for low in range(0, 0x20000, 1 << 10):
        text = "".join(f"ab{c}the {c}12{c}!{c}" for c in map(chr, range(low, low + (1 << 10))) if not 0xD800 <= ord(c) < 0xE000)
        words = find(text)
        assert "".join(words) == text
        assert [t for w in words for t in library._encode_single_piece(w)] == library.encode_ordinary(text)


def test_ranks_that_are_no_merges(tmp_path):
    with open(RANKS, "rb") as f:
        lines = f.read().split(b"\n")
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join([*lines[:256], b"YWJj 256"]))  # "abc" without "ab" or "bc"
    with pytest.raises(ValueError, match="rank 256"):
        byte_bpe.Ranks(str(path))


def all_runs(w, least=6, times=4):
    """Every stretch that repeats with some period and is as long as it can be, if no smaller period does."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            own = w[i : j + q]
            if j - i + q >= max(least, times * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def noisy(rng):
    n, k = rng.randint(0, 130), rng.choice([1, 2, 3, 5, 20, 200])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            a, p = rng.randrange(n), rng.randint(1, 12)
            for i in range(a, min(n, a + rng.randint(1, p * 7))):
                w[i] = w[a + (i - a) % p]
    return w


def test_runs():
    rng, seen = random.Random(5), 0
    for _ in range(1500):
        w = noisy(rng)
        want = all_runs(w)
        assert periodic.find(np.array(w, dtype=np.int64)) == want
        seen += len(want)
    assert seen > 500
    for w in ([0] * 5000, [i % 7 for i in range(5000)]):
        assert periodic.find(np.array(w, dtype=np.int64)) == [(0, 5000, len(set(w)))]
    assert periodic.find(np.array([i % 5 for i in range(60)]), times=6) == [(0, 60, 5)]


def test_regions_hold_all_squares():
    """The automaton over a whole text finds nothing that the regions leave out."""
    rng = random.Random(6)
    for _ in range(200):
        w = np.array(noisy(rng), dtype=np.int64)
        inside = periodic.regions(w, 6, 4)
        for s, n, _ in all_runs(w.tolist()):
            assert any(a <= s and s + n <= z for a, z in inside)
        ends = {(a, b) for a, b, long in periodic.squares(w.tolist()) if 3 * (b - a) <= long}
        assert {(s + n - q, s + n) for s, n, q in all_runs(w.tolist())} <= ends


def test_run_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(f"w{x}" for x in noisy(rng)) for _ in range(400)]
    texts += ["\t a\x0ba\x0ca\ra\n a a  ", "é é é é é é é", "           ", None, "", " \n", "a b " * 3000, texts[7]]
    rows = [*enumerate(texts), (None, "q " * 9), (3, "twice " * 8)]
    documents(spark, [(i, "s", t) for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        n = len(words)
        if i is not None and n:
            h = zlib.crc32(str(i).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = all_runs(words)
        dropped = {k for s, m, q in found for k in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert periodic.runs(documents(spark, [])).collect() == []


def test_reading_in_pairs():
    assert [byte_bpe.char(t) for t in (0, 54_999)] == ["Ā", chr(54_999 + 256)] and byte_bpe.tokens_of(byte_bpe.char(60_000)).tolist() == [60_000]
    assert not any(0xD800 <= ord(byte_bpe.char(t)) < 0xE000 for t in range(0, 120_000))
    assert all(a < b for a, b in itertools.pairwise(ord(byte_bpe.char(t)) for t in range(0, 120_000, 7)))
