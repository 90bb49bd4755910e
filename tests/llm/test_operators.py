import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.llm import bpe, chat_format, embed_dedup, line_dedup, media, mix, quality, simhash, suffix_dedup, token_counts
from spanveil.llm.components import components

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, source string, ids string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], DOCS)


def odd_rows():
    r = random.Random(5)
    text = lambda n: "".join(r.choice("ab é\n\t😀=- ") for _ in range(n))
    return [(1, None, "a"), (2, "", None), (3, "x", "a"), (3, "x", "a"), (None, "null id", "b"), (4, text(20_000), "b"), *((10 + i, text(60), "abc"[i % 3]) for i in range(20))]


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs(spark, odd_rows()), RANKS, P.PATTERN, offsets=True), RANKS, P.PATTERN).collect()
    for r in got:
        t = r.text or ""
        assert r.ids == tk.encode_ordinary(t) and r.decoded_text == t and len(r.offsets) == len(r.ids)
        at = 0
        for i, o in zip(r.ids, r.offsets, strict=True):  # a token's bytes lie in the characters that its offsets name, and tokens follow each other
            token = tk.decode_single_token_bytes(i)
            assert o.start < o.end and token in t[o.start : o.end].encode() and len(t[: o.start].encode()) <= at < len(t[: o.end].encode())
            at += len(token)
        assert at == len(t.encode())
    assert sorted(map(str, (r.ids for r in bpe.encode(docs(spark, odd_rows()), RANKS, P.PATTERN).collect()))) == sorted(str(r.ids) for r in got)
    assert bpe.round_trip(docs(spark, []), RANKS, P.PATTERN).count() == 0


def test_token_counts_equal_greedy(spark):
    with open(RANKS, "rb") as f:
        vocab = {base64.b64decode(x.split()[0]) for x in f}

    def greedy(w):
        n = at = 0
        while at < len(w):
            at = next(j for j in range(min(len(w), at + 130), at, -1) if w[at:j] in vocab)
            n += 1
        return n

    for r in token_counts.count_tokens(docs(spark, odd_rows()).withColumn("t2", F.col("text")), RANKS).collect():
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", r.t2 or "") if w]
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w.encode()) for w in words))
    assert token_counts.PieceCounter([b"ab", b"a"]).count(b"abx") == -1


def test_mix_is_near_targets(spark):
    rows = [(i, "w " * (i % 7), "s%d" % min(i % 5, 2)) for i in range(600)] + odd_rows()
    got = mix.mix_sources(docs(spark, rows), carry=("text", "source")).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix.mix_sources(docs(spark, rows), carry=("text", "source")).collect()))
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    longest = max(r.size for r in got)
    assert all(abs(t - n) <= longest for t, n in by.values()) and abs(sum(t for t, _ in by.values()) - sum(r.size for r in got)) < 1e-3
    assert mix.mix_sources(docs(spark, [])).count() == 0
    assert {(r.copies, r.taken) for r in mix.mix_sources(docs(spark, [(1, None, "a"), (2, "", None)])).collect()} == {(1, 0)}


@pytest.mark.parametrize("bands,edge", [(4096, 65_536), (3, 5)])
def test_mix_equals_a_sorted_queue(spark, monkeypatch, bands, edge):
    monkeypatch.setattr(mix, "BANDS", bands)
    monkeypatch.setattr(mix, "EDGE", edge)
    rows = [(i, "w " * (i * 7 % 11), "s%d" % min(i % 5, 2)) for i in range(300)] + odd_rows() + [(7, "w " * 5, "s0")] * 3
    got = mix.mix_sources(docs(spark, rows).repartition(3)).collect()
    words = lambda t: len([w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w])
    h = lambda i: hashlib.md5(("mix" + ("" if i is None else str(i))).encode()).hexdigest()[:16]
    target = {r.source_size: r.target for r in got}
    queue, sizes = [], {}
    for key in {(s is None, s) for _, _, s in rows}:
        own = sorted({(h(i), i is not None, i or 0, words(t)) for i, t, s in rows if (s is None, s) == key})
        many = {g: sum((h(i), i is not None, i or 0, words(t)) == g for i, t, s in rows if (s is None, s) == key) for g in own}
        total = sum(g[3] * many[g] for g in own)
        cum = 0
        for g in own:
            cum += g[3] * many[g]
            sizes[key, g] = 0
            if total:
                queue += [(float(cum + e * total) / target[total], key[0], key[1] or "", g, many[g] * g[3], key) for e in range(3)]
    left = sum(words(t) for _, t, _ in rows)
    for *_, g, n, key in sorted(queue):
        left -= n
        if left < 0:
            break
        sizes[key, g] += g[3]
    want = sorted((i is not None, i or 0, words(t), sizes[(s is None, s), (h(i), i is not None, i or 0, words(t))]) for i, t, s in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.taken) for r in got) == want


def test_chats_read_back(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant"]) if t else r.choice(["system", "user"]), r.choice(["</s>[INST] ok ~1", "w " * r.randrange(200), None, "é\n<s>"]), "x") for c in range(20) for t in range(r.randrange(1, 12))]
    rows += [(None, None, None, None, "x"), (99, 0, "system", "alone", "x"), (98, 1, "user", "same", "x"), (98, 1, "user", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window_no string")
    win = chat_format.format_chats(df, budget=120, history=30)
    assert all(not x.over_budget or x.n_new == 1 for x in win.collect())
    got = {x.conv_id: x for x in chat_format.read_back(win).collect()}
    for c in {x[0] for x in rows}:
        own = sorted(((x[1] is None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c))
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        want = hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_chats(df.limit(0))).count() == 0


def test_simhash_components_equal_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(x) for x in base] + [int(b) ^ sum(1 << int(k) for k in r.choice(64, r.integers(1, 7), replace=False)) for b in base for _ in range(8)] + [0, 0]
    rows = [(i, int(np.uint64(f).astype(np.int64)), "c") for i, f in enumerate(fps)]
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "doc_id long, fp long, component_id string")
    assert {x.doc_id: x.component_id for x in simhash.group(df).collect()} == {i: root(i) for i in range(len(fps))}
    assert simhash.group(df.limit(0)).count() == 0
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0 and simhash.fingerprint("A b\tc d") == __import__("xxhash").xxh64_intdigest("a b c d", 42)


def test_simhash_bits_are_majorities():
    """Texts of several shingles, repeats included, against a count of every bit by itself."""
    x = __import__("xxhash")
    for text in ("a b c d e f", "The the THE the the the a b", "one  two\tthree four\nfive one two three four", "é ß É x y z 😀 w", "few words"):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        h = [x.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        assert simhash.fingerprint(text) == sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))


def test_simhash_crowded_part_values(spark, monkeypatch):
    """Grids of blocks: one dense group, and many that share part values with it, in blocks of 8."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "FIRST", 2)
    r = np.random.default_rng(3)
    few = lambda bits, n: sum(1 << int(b) for b in r.choice(bits, n, replace=False))
    fps = sorted({few(14, r.integers(0, 4)) for _ in range(90)} | {few(14, r.integers(0, 3)) | (few(20, 7) << 40) for _ in range(90)} | {int(v) for v in r.integers(0, 1 << 63, 60)})
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    rows = [(i, f) for i, f in enumerate(fps)] + [(None, fps[0]), (0, fps[0])]
    got = simhash.group(spark.createDataFrame(rows, "doc_id long, fp long").repartition(3), max_bits=3).collect()
    assert sorted((x.doc_id, x.component_id) for x in got if x.doc_id is not None) == sorted([(i, root(i)) for i in range(len(fps))] + [(0, root(0))])
    assert [x.component_id for x in got if x.doc_id is None] == [root(0)]
    assert {x.component_id for x in simhash.group(spark.createDataFrame([(None, 5), (None, 5)], "doc_id long, fp long")).collect()} == {None}


def test_simhash_estimates_all_thresholds():
    """A uniform table has no reason to skip a part: equal thresholds are the cheapest."""
    r = np.random.default_rng(4)
    plan = simhash.Plan(4, 50_000, [list(range(k, 64, 5)) for k in range(5)])
    plan.learn({(i, j): np.full(1 << len(b), 50_000 / (1 << len(b))) for i, h in enumerate(plan.halves) for j, b in enumerate(h)})
    assert (plan.allocate(r.integers(0, 1 << 63, 100, dtype=np.uint64)) == 0).all()


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {x.node: x.root for x in components(e).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)]
    up = {i: i for p in pairs for i in p if p[0] != p[1]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame([*pairs, *pairs[:9], (None, 1)], "a long, b long")).collect()
    assert sorted((x.node, x.root) for x in got) == sorted((i, root(i)) for i in up)
    assert components(e.limit(0)).count() == 0


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 8))
    x = np.concatenate([x, x[:20] + 0.05 * r.normal(size=(20, 8)), x[:5], 3 * x[5:8]])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [1.0, None], 0), (904, [1.0, 1.0], 0)]
    got = {g.vec_id: g for g in embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int"), block=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    for i in range(len(x)):
        assert got[i].n_links == near[i].sum() - 1
        seen, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(near[todo.pop()]).tolist()) - seen
            seen |= new
            todo += new
        assert got[i].component_id == min(seen) and got[i].kept == (min(seen) == i)
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in range(900, 905))


def test_line_dedup_blocks(spark):
    long = [f"line {i} with a good many words in it so that it counts" for i in range(6)]
    rows = [(1, "\n".join(long), "a"), (2, "\n".join(["new start", *long[1:4], "", "new end"]), "a"), (3, "\n".join(long), "b"), (4, "short", "b"), (5, "short", "b"), (6, None, "c"), (7, "", "c"), (8, "own text " * 3000, "c")]
    got = {r.doc_id: r for r in line_dedup.delete_repeats(docs(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[2].text == "new start\n\nnew end" and got[3].text == "" and got[5].text == "short" and got[6].text is None and got[8].n_removed == 0
    assert line_dedup.patience([1, 2, 3, 4], [9, 1, 3, 4, 8]) == [(0, 1), (2, 2), (3, 3)]
    assert line_dedup.delete_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij é"])
def test_suffix_dedup_equals_brute_force(spark, alphabet):
    r, k = random.Random(9), 100
    make = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    shared = [make(150), make(260), "a" * 400]
    rows = [(i, "".join(r.choice([make(r.randrange(60)), r.choice(shared)[r.randrange(20):]]) for _ in range(4)), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, rows[0][1], "s"), (103, shared[2] * 3, "s")]
    raw = {i: (t or "").encode() for i, t, _ in rows}
    count = {}
    for b in raw.values():
        for p in range(len(b) - k + 1):
            count[b[p : p + k]] = count.get(b[p : p + k], 0) + 1
    got = {g.doc_id: g for g in suffix_dedup.remove_repeats(docs(spark, rows), length=k, keep_bytes=True).collect()}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - k + 1):
            if count[b[p : p + k]] > 1:
                gone[p : p + k] = True
        assert bytes(got[i].kept) == np.frombuffer(b, np.uint8)[~gone].tobytes() and got[i].n_removed == gone.sum()
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_loser_tree_merges_with_shared_prefixes():
    r = random.Random(4)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(9))) for _ in range(r.randrange(12))) for _ in range(7)]
    coded = [suffix_dedup.unfold(suffix_dedup.front_code([(t, b"", b"d" * 16) for t in run])) for run in runs]
    got = list(suffix_dedup.LoserTree(coded))
    want = sorted(t for run in runs for t in run)
    assert [t for _, t, _ in got] == want
    assert all(n == suffix_dedup.shared(a, b) for (n, b, _), a in zip(got[1:], want, strict=False))


def test_random_vectors_are_compared_plainly(monkeypatch):
    """Where a tree's level rules nothing out no node pair is expanded, and every kind of vectors has the pairs of all products."""
    r = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    random_, near = unit(r.normal(size=(700, 64))), unit(r.normal(size=(9, 64))[r.integers(0, 9, 700)] + 0.2 * r.normal(size=(700, 64)) * r.random((700, 1)))
    random_[350:500] = unit(random_[:150] + 0.03 * r.normal(size=(150, 64)))
    below, expanded = embed_dedup._below, []
    monkeypatch.setattr(embed_dedup, "_below", lambda t: expanded.append(1) or below(t))
    for x, plain in ((random_, True), (near, False)):
        trees = [embed_dedup.CoverTree.load(embed_dedup.CoverTree(y).dump()) for y in (x[:400], x[400:])]
        for a, b in ((trees[0], trees[1]), (trees[0], trees[0])):
            del expanded[:]
            got = [(int(m), int(n)) for i, j in embed_dedup.close_pairs(a, b, 0.95) for m, n in zip(i, j, strict=True)]
            want = {(m, n) for m, n in np.argwhere(a.x @ b.x.T >= 0.95).tolist() if a is not b or m < n}
            assert len(got) == len(set(got)) and {(min(p), max(p)) if a is b else p for p in got} == want and want and bool(expanded) != plain


def test_media_round_trip_and_damage(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    media.write_archives(docs(spark, odd_rows()), folder, key="doc_id")
    got = media.describe(media.read_archives(spark, folder, rangebytes="500")).collect()
    want = sorted((str(i) if i is not None else "", hashlib.sha256(media.payload_of(t)).hexdigest(), zlib.crc32(media.payload_of(t)[-32:]), len((t or "").encode())) for i, t, _ in odd_rows())
    assert sorted((g.key or "", g.payload_sha256, g.tail_crc32, g.n_bytes) for g in got) == want
    first = min((tmp_path / "m").glob("*.zip"), key=lambda p: p.name)
    raw = bytearray(first.read_bytes())
    raw[60] ^= 0xFF
    first.write_bytes(raw)
    again = media.read_archives(spark, folder, attempts="2").collect()
    assert len(again) == len(got) and sum(a.error is not None for a in again) == 1 and all((a.media is None) == (a.error is not None) for a in again)


def test_media_of_empty_parts_and_unreadable_archives(spark, tmp_path):
    none, some = f"file://{tmp_path}/none", f"file://{tmp_path}/some"
    media.write_archives(docs(spark, []), none)
    assert media.describe(media.read_archives(spark, none)).count() == 0
    media.write_archives(docs(spark, [(1, "a", "s")]).union(docs(spark, [(2, None, "s"), (3, "b", "s")]).where("doc_id > 5")).repartition(4), some)
    (tmp_path / "some" / "part-000099.zip").write_bytes(b"no archive")
    (tmp_path / "some" / "part-000100.zip").write_bytes(b"")
    got = sorted(media.read_archives(spark, some, attempts="2", rangebytes="4").collect(), key=lambda r: r.archive)
    assert [(r.key, r.media is None, r.error is None) for r in got] == [("1", False, True), (None, True, False), (None, True, False)]
    assert [r.n_bytes for r in media.describe(media.read_archives(spark, some, attempts="1")).where("error is not null").collect()] == [None, None]


def test_media_failures_are_no_results(spark, tmp_path, monkeypatch):
    """What can't be read or isn't an image ends the query, or says so in its row."""
    import zipfile

    from spanveil.llm import queries

    folder = tmp_path / "m"
    media.write_archives(docs(spark, [(1, "a", "s")]), f"file://{folder}")
    with zipfile.ZipFile(folder / "part-000099.zip", "w") as z:
        z.writestr("0/7.png", b"no image")
    got = {r.key: r for r in media.describe(media.read_archives(spark, f"file://{folder}")).collect()}
    assert got["1"].error is None and got["7"].error.startswith("ValueError") and got["7"].payload_bytes is None and got["7"].media_bytes == 8

    reader = media.Reader({"path": f"file://{folder}", "attempts": "1"})
    monkeypatch.setattr(reader, "directory", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    lost = [b.to_pylist() for b in reader.read(media.Range(str(folder / "part-000099.zip"), 8, 16))]
    assert [r["error"] for b in lost for r in b] == ["OSError: gone"]  # by a range that isn't the first

    docs(spark, [(1, "a", "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    write = media.write_archives
    for harm in (lambda p: p.write_bytes(b"no archive"), lambda p: p.write_bytes(p.read_bytes()[:60] + b"?" + p.read_bytes()[61:]), lambda p: (folder / "part-000099.zip").replace(p)):
        def broken(df, to, harm=harm):
            write(df, to)
            harm(next(__import__("pathlib").Path(to.removeprefix("file://")).glob("*.zip")))

        monkeypatch.setattr(media, "write_archives", broken)
        with pytest.raises(Exception, match="BadZipFile|damaged member|not a PNG"):
            queries.op10_media_columns(spark, str(tmp_path)).collect()


def test_media_forms_read_by_hand(spark, tmp_path):
    """The stored image, its digest and the feature, against an own reading of the format and a plain loop."""
    folder = f"file://{tmp_path}/m"
    media.write_archives(docs(spark, odd_rows()), folder)
    stored = {(r.archive, r.offset): r.media for r in media.read_archives(spark, folder).collect()}
    for g in media.describe(media.read_archives(spark, folder)).collect():
        m = stored[g.archive, g.offset]
        at, idat, size = 8, b"", None
        while at < len(m):
            n = int.from_bytes(m[at : at + 4], "big")
            kind, body = m[at + 4 : at + 8], m[at + 8 : at + 8 + n]
            size = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9]) if kind == b"IHDR" else size
            idat, at = idat + body * (kind == b"IDAT"), at + 12 + n
        lines = zlib.decompress(idat)
        p = b"".join(lines[i + 1 : i + 577] for i in range(0, len(lines), 577))
        cuts = [k * len(p) // 64 for k in range(65)]
        bits = "".join("1" if sum(p[a:b]) * len(p) > (b - a) * sum(p) else "0" for a, b in zip(cuts, cuts[1:], strict=False))
        assert size == (576, len(p) // 576, 8, 0) and (g.media_bytes, g.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
        assert g.feature == f"{len(p) // 576}:{sum(p) / len(p):.3f}:{int(bits, 2):016x}" and p.rstrip(b"\xff") in {(t or "").encode() for _, t, _ in odd_rows()}


def test_quality_fit_equals_gradient_descent():
    """Newton's minimum of the pairwise loss against plain gradient descent on the same pairs."""
    r = np.random.default_rng(5)
    x = np.zeros((400, quality.N_FEATURES))
    x[:, :3] = r.normal(size=(400, 3))
    good = (x[:, :3] @ [1.0, -2.0, 0.5] + r.normal(size=400) > -0.5).astype(int)
    got = quality.fit(x, good)
    z = np.clip((x - got.mean) / got.scale, -6, 6)[:, :3]
    pick = np.random.default_rng(7)
    d = z[pick.choice(np.flatnonzero(good == 1), quality.PAIRS)] - z[pick.choice(np.flatnonzero(good == 0), quality.PAIRS)]
    w = np.zeros(3)
    for _ in range(4000):
        p = 1 / (1 + np.exp(d @ w))
        w += 0.5 * (d.T @ p / len(d) - 1e-3 * w)
    assert np.allclose(got.weights[:3], w, atol=1e-3) and not got.weights[3:].any()
    assert abs((got.score(x) < quality.CUT).mean() - (good == 0).mean()) < 0.01


def test_quality_ranks_held_out(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("etaoinsr") for _ in range(r.randrange(2, 8)))
    rows = [(i, " ".join(word() + ("###" if i % 4 == 0 else "") for _ in range(60)), "s") for i in range(200)] + [(500, None, "s"), (501, "", "s")]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)] + [(None, 1, 0), (1, None, 0), (1, 7, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in quality.score(docs(spark, rows), quality.train(docs(spark, rows), labels)).collect()}
    assert all((got[i] >= quality.CUT) == (i % 4 != 0) for i in range(200)) and 0 <= got[500] == got[501] <= 1
    twice = quality.train(docs(spark, rows + rows[:50]), labels.union(labels))
    assert {x.doc_id: x.score for x in quality.score(docs(spark, rows).withColumn("score", F.lit("clash")), twice).collect()} == got
    assert quality.score(docs(spark, []), twice).count() == 0 and quality.train(docs(spark, []), labels).weights.any() is np.False_
    flat = quality.train(docs(spark, rows), labels.limit(0))
    assert {round(x.score, 9) for x in quality.score(docs(spark, rows[:3]), flat).collect()} == {0.3}


def all_pair_lines(rows):
    """Lines that alignment of each document with all earlier ones deletes, by document."""
    own = {i: t.split("\n") for i, t, _ in rows}
    h, w = {i: [hash(x) if x else 0 for x in ls] for i, ls in own.items()}, {i: [len(x.split()) for x in ls] for i, ls in own.items()}
    return {i: {k for j in own if j < i for a, b in line_dedup.blocks(h[i], w[i], h[j], 10) for k in range(a, b)} for i in own}


def deleted_lines(spark, rows):
    got = {r.key: {k for s in r.spans for k in range(s.start, s.end)} for r in line_dedup.find_repeats(docs(spark, rows)).collect()}
    return {i: got.get(f"{i}:{hashlib.md5(t.encode()).hexdigest()}", set()) for i, t, _ in rows}


def test_line_dedup_tries_all_earlier_holders(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "EACH", 2)
    r = random.Random(6)
    long = [f"line {i} with a good many words in it so that it counts" for i in range(12)]
    fresh = lambda i, n: [f"only {i} {k} " + "own " * 12 for k in range(n)]
    rows = [(1, "\n".join(["p", long[0], "q", long[0], "r"]), "a"), (2, "\n".join(["s", long[0], "t"]), "a"), (3, "\n".join(["u", long[0], "v"]), "a")]
    for i in range(10, 50):
        ls = [r.choice(long) for _ in range(r.randrange(1, 6))] + fresh(i, 2)
        r.shuffle(ls)
        rows.append((i, "\n".join(ls), "a"))
    want = all_pair_lines(rows)
    assert deleted_lines(spark, rows) == want and want[3] == {1} and want[2] == set()


def test_line_dedup_of_short_lines_that_many_have(spark):
    r = random.Random(8)
    short = [f"short line {i} of a passage that all have" for i in range(8)]
    rows = [(i, "\n".join([f"head {i}", *short, f"tail {i}"]), "a") for i in range(1, 61)]
    few = ["", "a", "b c", "d e f", "g h i j", "k l m n o", short[0], "one line with more than ten words in it to link alone"]
    rows += [(i, "\n".join(r.choice(few) for _ in range(r.randrange(1, 12))), "a") for i in range(100, 180)]
    want = all_pair_lines(rows)
    same = {i for i, t, _ in rows if any(t == u and j < i for j, u, _ in rows)}
    got = deleted_lines(spark, rows)
    assert all(got[i] == want[i] for i in want if i not in same) and all(got[i] == set(range(1, 9)) for i in range(2, 61))
    assert any(i not in same and want[i] for i in range(100, 180))


def test_line_dedup_of_null_and_repeated_ids(spark):
    block = "\n".join(f"shared line {i} that has quite a few words in it" for i in range(3))
    rows = [(None, f"a\n{block}", "s"), (None, f"b\n{block}", "s"), (4, f"c\n{block}\nd", "s"), (4, f"c\n{block}\nd", "s"), (4, f"e\n{block}", "s"), (9, None, "s"), (None, None, "s")]
    df = docs(spark, rows).withColumn("n_lines", F.lit("clash")).withColumn("spans", F.lit("clash"))
    got = sorted((r.doc_id or 99, r.text or "", r.n_removed) for r in line_dedup.delete_repeats(df).collect())
    # of the two texts of id 4 the one with the smaller md5 is the earlier
    first, other = sorted((f"c\n{block}\nd", f"e\n{block}"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    cut = lambda t: t.replace(block + "\n", "").replace("\n" + block, "")
    texts = [first if t == first else cut(t) for t in (rows[2][1], rows[3][1], rows[4][1])]
    assert got == sorted([(4, t, 0 if t == first else 3) for t in texts] + [(9, "", 0), (99, "", 0), (99, "a", 3), (99, "b", 3)]) and other


def test_embeddings_of_null_ids_repeats_and_nothing(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.001]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [0.0, 2.0]), (None, [-1.0, 0.0]), (None, None), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash")).withColumn("size", F.lit(1))
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embed_dedup.link_vectors(df).collect()))
    assert got == sorted([(0, 1, 0, False)] * 2 + [(5, 2, 5, True)] * 2 + [(6, 2, 5, False), (0, 0, 0, False), (0, 0, 0, False), (7, 0, 7, True)])
    assert embed_dedup.link_vectors(df.limit(0)).count() == 0


def test_suffix_dedup_of_null_ids_and_clashing_names(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(150))
    rows = [(None, "p" + text, "s"), (None, text + "q", "s"), (1, "r" + text, "s"), (None, None, "s")]
    df = docs(spark, rows).withColumn("n_bytes", F.lit("clash")).withColumn("md5", F.lit("clash")).withColumn("spans", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_bytes) for r in suffix_dedup.remove_repeats(df, length=100).collect())
    assert got == [(0, 0, 0, 0, 0), (0, 151, 150, 1, 1), (0, 151, 150, 1, 1), (1, 151, 150, 1, 1)]


def test_token_counts_of_nothing_and_clashes(spark):
    assert token_counts.count_tokens(docs(spark, []), RANKS).count() == 0
    got = token_counts.count_tokens(docs(spark, [(None, None, "s"), (1, "a", "s"), (1, "a", "s")]).withColumn("n_tokens", F.lit("clash")), RANKS).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_words, r.n_tokens) for r in got) == [(0, 0, 0, 0), (1, 1, 1, 1), (1, 1, 1, 1)]
