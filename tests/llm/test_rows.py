"""Rows without ids, with repeated ids and under two sources, each operator's whole result against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from quillmark.llm import embedding_dedup, lines, mixing, nearest, packing, simhash, substrings


def made_rows() -> list[tuple]:
    """(doc_id, text, source): ten null ids, ids with other texts, one id and text under two sources, whole repeats."""
    rng = np.random.default_rng(21)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 500, n)]
    texts = [" ".join(words(40)) for _ in range(16)]
    shared = " ".join(words(20))
    rows = [(None, texts[k] if k % 3 else f"{texts[k]} {shared}", "a") for k in range(10)]
    rows += [(1, f"{shared} {texts[10]}", "a"), (1, texts[11], "b"), (2, texts[12], "a"), (2, texts[12], "b"), (3, texts[13], None), (3, texts[13], None)]
    rows += [(4, f"{texts[14]} {shared} {texts[15]}", "c"), (5, texts[0], "c"), (6, None, "a"), (6, None, "a"), (7, "", "b"), (None, None, None)]
    return rows


ROWS = made_rows()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").cache()


def order(doc):
    return 2**63 - 1 if doc is None else doc


def counted(done, *names):
    return Counter(tuple(r[n] for n in names) for r in done.collect())


def test_mixing(spark, rows):
    done = mixing.op1(rows).collect()
    assert Counter((r["doc_id"], r["size"]) for r in done) == Counter((d, len((t or "").split())) for d, t, _ in ROWS)
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(names, mixing.targets([sizes[s] for s in names], mixing.cycled(names)), strict=True))
    assert Counter((r["source_size"], round(r["target"], 6)) for r in done) == Counter((sizes[s], round(wanted[s], 6)) for _, _, s in ROWS)
    assert all(r["taken"] <= 3 * r["size"] for r in done)
    for s in names:
        taken = sum(r["taken"] for r in done if (r["source_size"], r["target"]) == (sizes[s], wanted[s]))
        assert abs(taken - wanted[s]) <= 0.1 * wanted[s] + 1
    # One id and text under two sources: as one source each, the two rows take what their source's share is.
    two = spark.createDataFrame([(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "y")], "doc_id long, text string, source string")
    assert sum(r["taken"] for r in mixing.op1(two).collect()) == pytest.approx(16, abs=1)


def test_draws_of_tasks_are_the_plain_ones(spark):
    for owed, slots in (([100, 7, 0, 893], 64), ([5], 64), ([0, 0], 64), ([3000, 1], 100)):
        want = mixing.shard_draws(owed, slots, 4)
        got, first = np.zeros_like(want), np.cumsum(want, axis=0) - want
        for r in mixing.planned_slots(spark, owed, slots, 4).collect():
            got[r["shard"], r["sid"]] += r["count"]
            assert first[r["shard"], r["sid"]] == r["first"]
        assert (got == want).all() and want.sum(axis=0).tolist() == owed


def test_mixed_documents_keep_their_sources(spark):
    two = spark.createDataFrame([(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "y"), (2, "p q", "y")], "doc_id long, text string, source string")
    done = mixing.mixed_documents(two).collect()
    taken = Counter()
    for r in done:
        taken[r["source"]] += len(r["text"].split())
    assert taken["x"] == pytest.approx(12.9, abs=1.5) and taken["y"] == pytest.approx(5.1, abs=1.5)


def test_substrings(rows):
    first: dict[tuple, int] = {}
    for d, t, _ in ROWS:
        w = (t or "").split()
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, order(d)), order(d))
    want = Counter()
    for d, t, _ in ROWS:
        w = (t or "").split()
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < order(d) for k in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert counted(substrings.op6(rows), "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("extra", ["", "<|endoftext|>"])
def test_packing(spark, rows, extra):
    from pyspark.sql import functions as F

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    given = rows.withColumn("text", F.concat("text", F.lit(extra), "text", F.lit(extra))) if extra else rows
    want = Counter()
    for d, t, _ in ROWS:
        t = None if t is None else t + extra + t + extra if extra else t
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        start = 0
        for n in packing.cut(len(ids)):
            want[(d, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids))] += 1
            start += n
    done = packing.op7(given).cache()
    assert counted(done, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == want
    places = done.select("sequence_id", "offset", "length").collect()
    for s in {p["sequence_id"] for p in places}:
        own = sorted((p["offset"], p["length"]) for p in places if p["sequence_id"] == s)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048


def test_long_texts_with_added_tokens(spark):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    text = "some words <|endoftext|> and more\n" * 3000
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    pieces = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_ids=True).orderBy("start").collect()
    assert [x for p in pieces for x in p["ids"]] == ids


def connected(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash(rows):
    def fingerprint(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        if not w:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for _, t, _ in ROWS]
    roots = connected(len(ROWS), [(i, j) for i in range(len(ROWS)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {r: min(order(ROWS[k][0]) for k in range(len(ROWS)) if roots[k] == r) for r in set(roots)}
    want = Counter((ROWS[k][0], f"{prints[k]:016x}", None if least[roots[k]] == 2**63 - 1 else least[roots[k]]) for k in range(len(ROWS)))
    assert counted(simhash.op8(rows), "doc_id", "fingerprint", "component_id") == want


def test_lines(spark):
    given = [(d, None if t is None else t.replace(" ", "\n"), s) for d, t, s in ROWS]
    places = sorted({(order(d), t) for d, t, _ in given if t is not None}, key=lambda x: (x[0], x[1]))
    done = counted(lines.op10(spark.createDataFrame(given, "doc_id long, text string, source string")), "doc_id", "n_lines")
    assert done == Counter((d, 0 if t is None else len(t.split("\n"))) for d, t, _ in given)
    # Which row of equal ids comes first is told by a hash, so what stays is counted: each window once.
    kept = [r["text"].split("\n") for r in lines.documents_without_repeats(spark.createDataFrame(given, "doc_id long, text string, source string").dropDuplicates(["doc_id", "text"])).collect() if r["text"]]
    every = {tuple(t.split("\n")[i : i + 3]) for _, t in places for i in range(len(t.split("\n")) - 2)}
    held = Counter(tuple(x[i : i + 3]) for x in kept for i in range(len(x) - 2))
    assert all(held[w] <= 1 for w in every)


def test_one_document_of_each_group(spark, rows):
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.deduplicate(rows).collect())
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(max(1, len(w) - 4))} if (t or "").split() else set()
    sets = [shingles(t) for _, t, _ in ROWS]
    alike = lambda a, b: (a == b) or (a and b and len(a & b) >= 0.8 * len(a | b))
    roots = connected(len(ROWS), [(i, j) for i in range(len(ROWS)) for j in range(i) if alike(sets[i], sets[j])])
    assert sum(kept.values()) == len(set(roots))
    for r in set(roots):
        group = [k for k in range(len(ROWS)) if roots[k] == r]
        first = min(order(ROWS[k][0]) for k in group)
        assert sum(kept[x] for x in {(ROWS[k][0], ROWS[k][1]) for k in group if order(ROWS[k][0]) == first}) == 1


def made_vectors() -> list[tuple]:
    rng = np.random.default_rng(22)
    x = rng.normal(size=(40, 6))
    x[20:] = x[:20] + 0.2 * rng.normal(size=(20, 6))
    ids = [None] * 10 + [7] * 6 + [100, 100, 100, 0, 0, 200] + list(range(300, 318))
    x[18], x[30] = x[17], 1e200 * x[30] / np.abs(x[30]).max()
    return [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]


def test_vector_links(spark):
    data = made_vectors()
    x = np.array([v for _, v in data])
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    roots = connected(len(x), np.argwhere(near).tolist())
    least = {r: min(order(data[k][0]) for k in range(len(x)) if roots[k] == r) for r in set(roots)}
    want = Counter((d, int(near[k].sum()), None if least[roots[k]] == 2**63 - 1 else least[roots[k]], order(d) == least[roots[k]]) for k, (d, _) in enumerate(data))
    for dense in (512, 8):
        done = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"), dense=dense, block=64)
        got = Counter((None if r["vid"] == 2**63 - 1 else r["vid"], r["n_links"], None if r["component"] == 2**63 - 1 else r["component"], r["vid"] == r["component"]) for r in done.collect())
        assert got == want
    assert counted(embedding_dedup.op2(spark.createDataFrame(data, "vec_id long, embedding array<double>")), "vec_id", "n_links", "component_id", "kept") == want


def test_nearest(spark):
    data = made_vectors()
    x = np.array([v for _, v in data])
    done = nearest.op4(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    for asked in (0, 100, 200, 300):
        own = min((v, k) for k, (d, v) in enumerate(data) if d == asked)[1]
        with np.errstate(over="ignore"):
            distances = [(float(np.hypot.reduce(x[own] - x[k])), order(d)) for k, (d, _) in enumerate(data) if k != own]
        got = sorted((r["rank"], order(r["vec_id"]), r["score"]) for r in done if r["query_id"] == asked)
        want = sorted(distances)[:10]
        assert [g[1] for g in got] == [w[1] for w in want] and [g[2] for g in got] == pytest.approx([w[0] for w in want])


def test_nearest_of_large_vectors(spark):
    rng = np.random.default_rng(23)
    x = rng.normal(size=(50, 8)) * 1e200
    done = nearest.op4(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    d = np.sqrt((((x - x[0]) / 1e200) ** 2).sum(axis=1)) * 1e200
    d[0] = np.inf
    assert [r["vec_id"] for r in done] == np.argsort(d)[:10].tolist() and [r["score"] for r in done] == pytest.approx(np.sort(d)[:10].tolist())


def test_recall_of_similar_texts(spark):
    """Pairs of texts of 60 to 400 words around the threshold, against their exact index."""
    rng = np.random.default_rng(24)
    texts, index = [], []
    for k in range(300):
        words = [f"u{k}x{n}" for n in range(int(rng.integers(60, 400)))]
        other = list(words)
        for at in rng.choice(len(words), max(1, round(len(words) * float(rng.uniform(0.008, 0.03)))), replace=False):
            other[at] = "changed"
        a, b = (set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (words, other))
        index.append(len(a & b) / len(a | b))
        texts += [" ".join(words), " ".join(other)]
    groups = {r["did"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    told = np.array([groups[2 * k] == groups[2 * k + 1] for k in range(300)])
    index = np.array(index)
    assert (index >= 0.8).sum() > 100 and told[index >= 0.8].mean() >= 0.97 and told[(index >= 0.8) & (index < 0.85)].mean() >= 0.9
    assert told[index < 0.72].mean() <= 0.02


def test_kept_index_takes_batch_after_batch(spark, tmp_path):
    """Three calls with one folder, runs compacted between them, against one call over all."""
    rng = np.random.default_rng(25)
    texts = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 200, 30)]
        if k > 5 and rng.random() < 0.6:
            words[10:10] = texts[int(rng.integers(k))].split()[:20]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r["did"]: r["starts"] for r in substrings.remove_repeats(docs).collect()}
    folder, got = f"file://{tmp_path}/log", {}
    for upto in (20, 45, 60):
        done = substrings.remove_repeats(docs.filter(f"doc_id < {upto}"), folder=folder, fanout=3).collect()
        assert {r["did"] for r in done} == set(range(len(got), upto))
        got |= {r["did"]: r["starts"] for r in done}
        from quillmark.llm.common import Scratch

        log = substrings.FingerprintLog(spark, Scratch(spark, "test"), 3, folder)
        assert len(log.runs) < 3 and log.upto == upto - 1 and len([x for x in log.kept.names() if x.startswith("state-")]) == 1
    assert got == want
    assert substrings.remove_repeats(docs, folder=folder).collect() == []


def test_network_is_the_plain_one():
    """Probabilities against a loop over positions and filters, gradients against differences."""
    from quillmark.llm import language as lang

    rng = np.random.default_rng(26)
    net = lang.ByteNet(["a", "b", "c"], 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (4, lang.LENGTH)).astype(np.uint8), np.array([0, 2, 1, 2])

    def plain():
        out = []
        for row in x:
            hidden = []
            for f in range(len(net.p["bias"])):
                width = lang.WIDTHS[f // lang.FILTERS]
                last = lang.LENGTH - max(lang.WIDTHS) + 1
                sums = [sum(net.p["embedding"][row[at + k]] @ net.p["filters"][k * lang.EMBEDDED : (k + 1) * lang.EMBEDDED, f] for k in range(width)) for at in range(last)]
                hidden.append(max(0.0, max(sums) + net.p["bias"][f]))
            z = np.array(hidden) @ net.p["out"] + net.p["out_bias"]
            out.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        return np.array(out)

    assert np.allclose(plain(), net.probabilities(x), atol=1e-5)
    loss = lambda: float(-np.log(net._softmax(np.maximum((net._patches(x) @ net.p["filters"]).max(axis=1) + net.p["bias"], 0) @ net.p["out"] + net.p["out_bias"])[np.arange(4), y]).mean())
    grads = net.gradients(x, y)
    for name, at in (("out", (3, 1)), ("out_bias", (2,)), ("bias", (1,)), ("filters", (0, 2)), ("embedding", (int(x[0, 5]), 1))):
        before = net.p[name][at]
        ends = []
        for step in (1e-5, -1e-5):
            net.p[name][at] = before + step
            ends.append(loss())
        net.p[name][at] = before
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_stray_languages_stop_nothing(spark):
    from quillmark.llm import language

    rows = [(k, f"word number {k} of a text", f"stray{k}" if k % 2 else "en") for k in range(1000)]
    done = language.op3(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert done.count() == 1000


def test_deduplicate_keeps_the_same_of_rows_alike(spark):
    """Rows alike in id and text, from two sources: the one that comes first by its other columns stays, however they are dealt."""
    text = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([(1, text, "en", f"s{9 - k % 7}", len(text)) for k in range(21)], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        assert [r["source"] for r in simhash.deduplicate(rows.repartition(parts)).collect()] == ["s3"]
