"""Each method against brute force on small tables."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmark.llm import embedding_dedup, language, lines, mixing, nearest, packing, simhash, substrings, urls
from quillmark.llm.common import WORD, Scratch
from quillmark.llm.components import components
from quillmark.llm.html import extract

VOCABULARY = np.array([f"v{k}" for k in range(30)])


def made_texts(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    texts: list[str] = []
    for _ in range(n):
        words = list(rng.choice(VOCABULARY, rng.integers(0, 60)))
        if texts and rng.random() < 0.5:
            other = texts[rng.integers(len(texts))].split()
            cut = rng.integers(0, len(other) + 1)
            words[len(words) // 2 : len(words) // 2] = other[cut : cut + 20]
        texts.append(" ".join(words))
    return texts


def union(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(k, k + 1) for k in range(200)] + [tuple(map(int, x)) for x in rng.integers(300, 500, (120, 2))]
    found = components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test")).collect()
    want = union(500, pairs)
    assert {(r["a"], r["root"]) for r in found} == {(k, w) for k, w in enumerate(want) if w != k}


@pytest.mark.parametrize("crowd", [256, 2])
def test_simhash_links(spark, crowd):
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(0, 2**63, 60)}
    for x in list(prints)[:20]:
        for _ in range(6):
            prints.add(x ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))))
    prints = sorted(prints)
    frame = spark.createDataFrame([(x,) for x in prints], "fp long")
    found = {(r["a"], r["b"]) for r in simhash.links(frame, Scratch(spark, "test"), crowd).collect()}
    close = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    place = {x: k for k, x in enumerate(prints)}
    assert union(len(prints), [(place[a], place[b]) for a, b in found]) == union(len(prints), close)


def test_similar_groups(spark):
    rng = np.random.default_rng(9)
    texts, pairs = [], []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 4000, 300)]
        texts.append(" ".join(words))
        for n in (1, 3) if k < 40 else ():
            near = list(words)
            for at in rng.integers(0, 300, n):
                near[at] = "changed"
            pairs.append((len(texts) - n // 2 - 1, len(texts)))
            texts.append(" ".join(near))
    far = " ".join(texts[0].split()[:150] + [f"z{k}" for k in range(150)])
    texts += [far, texts[3].upper(), None, ""]
    pairs += [(3, len(texts) - 3), (len(texts) - 2, len(texts) - 1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r["component"] for r in simhash.similar_groups(rows).orderBy("did").collect()]
    assert found == union(len(texts), pairs)


def test_crowded_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 1 / 64)  # a pair is as crowded as 128 chunks
    rng = np.random.default_rng(12)
    words, texts = [f"w{x}" for x in rng.integers(0, 4000, 300)], []
    for k in range(40):
        for at in range(4):  # 0.87 to the text before, and no link to the rest
            words[(at * 70 + k * 7) % 300] = f"c{k}-{at}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component"] for r in simhash.similar_groups(rows).collect()} == {0}


def test_wide_fingerprint_tells_similarity():
    rng = np.random.default_rng(10)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 1000)]
    near = list(words)
    for at in range(0, 1000, 40):
        near[at] = "changed"
    a, b = (simhash.shingle_set(" ".join(x), 5) for x in (words, near))
    index = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = (int.from_bytes(simhash.wide_fingerprint(" ".join(w))) for w in (words, near))
    assert abs((x ^ y).bit_count() - simhash.most_bits(index)) < 70


def test_simhash_fingerprint():
    text = "The QUICK brown\tfox Jumps over É"
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.simhash(text) == want and simhash.simhash(None) == 0 and simhash.simhash("one TWO") == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings(spark, batches):
    texts = made_texts(3, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first: dict[tuple, int] = {}
    for k, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    found = {r["did"]: r["starts"] for r in substrings.remove_repeats(docs, batches).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        want = [i for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < k]
        got = found[k] or []
        assert got == want or got == [substrings.ALL] and want == list(range(len(w) - 12))


def test_fingerprint_log_compacts(spark):
    scratch = Scratch(spark, "test")
    log = substrings.FingerprintLog(spark, scratch, fanout=3)
    batches = [[(k, d) for k in range(d, d + 5)] for d in range(6)]
    found = [sorted(r["g"] for r in log.add(spark.createDataFrame(b, "g long, did long")).collect()) for b in batches]
    assert found[0] == [] and found[1] == [1, 2, 3, 4] and found[5] == [5, 6, 7, 8] and len(log.runs) < 3


def test_lines_first_occurrence_stays(spark):
    docs = spark.createDataFrame([(2, "x\na\nb\nc\ny"), (1, "a\nb\nc\nd"), (3, "a\nb"), (4, "b\nc\nd\nb\nc\nd")], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in lines.documents_without_repeats(docs).collect()}
    assert kept == {1: "a\nb\nc\nd", 2: "x\ny", 3: "a\nb", 4: ""}


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.targets([1, 100], [5, 2]) == pytest.approx([3, 98])
    assert mixing.targets([0, 5], [5, 2]) == pytest.approx([0, 5])


def test_permutation_is_one():
    for n in (1, 2, 3, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, (1, 2, 3)).tolist()) == list(range(n))


def test_draws_give_what_is_owed():
    draws = mixing.shard_draws([100, 7, 0, 893], 64, 1)
    assert draws.sum(axis=0).tolist() == [100, 7, 0, 893] and set(draws.sum(axis=1)[:-1].tolist()) <= {64} | set(range(55, 64))


def test_mix_near_targets_and_alike(table):
    docs = table("documents")
    rows = mixing.op1(docs).toPandas()
    again = mixing.op1(docs.repartition(7)).toPandas()
    assert rows.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert (rows.taken <= 3 * rows["size"]).all()
    joined = rows.merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    sums = joined.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), source_size=("source_size", "first"))
    assert ((sums.taken - sums.target).abs() <= 0.05 * sums.target).all() and (sums["size"] == sums.source_size).all()
    assert abs(sums.target.sum() - sums["size"].sum()) < 1e-6


def test_packing(table):
    from tokenizers import Tokenizer

    docs = table("documents").limit(80)
    pieces = packing.op7(docs).toPandas()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc, own in pieces.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        own = own.sort_values("start")
        assert own.start.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    used = 0
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and own.length.sum() <= 2048
        used += 2048
    assert pieces.length.sum() > 0.95 * used


def test_tokenizer_agrees_on_odd_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    tokenizer, fast = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def agree(text):
        assert tokenizer.encode(text, add_special_tokens=False).ids == fast.encode_ordinary(text)

    agree()


def test_tokenizer_agrees_on_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["<|endoftext|>", "one <|endoftext|> two<|endoftext|><|endoftext|>\n three", " <|endoftext| > <|ENDOFTEXT|>", ""]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).orderBy("did").collect()
    assert [r["ids"] for r in rows] == [[*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]


def test_cut_fills_slots():
    for n in range(0, 9000, 7):
        pieces = packing.cut(n)
        assert sum(pieces) == n and all(0 < x <= 2048 for x in pieces)


def test_language_held_out(table):
    docs = table("documents")
    rows = language.op3(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert rows.held_out.tolist() == [zlib.crc32(str(d).encode()) % 3 == 1 for d in rows.doc_id]
    assert (rows[rows.held_out].lang == rows[rows.held_out].lang_pred).mean() > 0.95 and rows.score.between(0, 1).all()


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x[200:] = x[:200] + 0.25 * rng.normal(size=(200, 16))
    x[390:] = x[0]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicates(rows, reach=64, block=128).toPandas().sort_values("vid")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert (found.n_links.to_numpy() <= near.sum(1)).all() and found.n_links.sum() >= 0.97 * near.sum()
    whole = embedding_dedup.near_duplicates(rows, reach=512, block=512).toPandas().sort_values("vid")
    assert whole.n_links.tolist() == near.sum(1).tolist() and whole.component.tolist() == union(len(x), np.argwhere(near).tolist())


def test_passes_project_at_every_size(spark, table):
    """Whole table of the smallest scale: at least one bit, several passes, and all but a few of the links that brute force finds."""
    rows = table("embeddings")
    data = rows.toPandas()
    x = np.array(data.embedding.tolist(), np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    classes = rows.selectExpr("vec_id as rep", "cast(embedding as array<double>) as v")
    bits = embedding_dedup._bits_for(classes, x.shape[1], len(x), 0.9, embedding_dedup.REACH, 42)
    assert bits >= 1 and embedding_dedup.passes_for(bits) >= 3
    found = embedding_dedup.near_duplicates(rows.withColumnRenamed("vec_id", "vec_id"), reach=8).toPandas().set_index("vid").loc[data.vec_id]
    assert (found.n_links.to_numpy() <= near.sum(1)).all() and found.n_links.sum() >= 0.95 * near.sum()


def test_dense_cores_lose_no_link(spark):
    rng = np.random.default_rng(7)
    u = rng.normal(size=(6, 24))
    x = np.concatenate([u[0] + 0.15 * rng.normal(size=(300, 24)), u[0] + 0.35 * rng.normal(size=(60, 24)), u[1] + 0.1 * rng.normal(size=(150, 24)), 0.75 * u[0] + 0.4 * u[1] + 0.2 * rng.normal(size=(60, 24)), rng.normal(size=(80, 24))])
    x[10] = x[11]
    x = x[rng.permutation(len(x))]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    found = embedding_dedup.near_duplicates(rows, reach=len(x), block=len(x) + 1, dense=60).toPandas().sort_values("vid")
    assert found.n_links.tolist() == near.sum(1).tolist() and found.component.tolist() == union(len(x), np.argwhere(near).tolist())
    split = embedding_dedup.near_duplicates(rows, reach=len(x), block=150, dense=60).toPandas().sort_values("vid")
    assert split.n_links.tolist() == near.sum(1).tolist() and split.component.tolist() == found.component.tolist()


def test_loose_groups_keep_their_links(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(3, 64))
    loose = centres[0] + 0.29 * rng.normal(size=(1500, 64))  # pairs at 0.92, so nothing within half the angle
    topical = centres[1] + 0.65 * rng.normal(size=(800, 64))  # pairs at 0.7, no links
    x = np.concatenate([loose, topical, rng.normal(size=(700, 64))])[rng.permutation(3000)]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    found = embedding_dedup.near_duplicates(rows, reach=8, block=200, dense=100).toPandas().sort_values("vid")
    assert near.sum() > 10**6 and (found.n_links.to_numpy() <= near.sum(1)).all() and found.n_links.sum() >= 0.98 * near.sum()
    assert found.component.tolist() == union(len(x), np.argwhere(near).tolist())


def test_nearest_recall(table):
    rows = table("embeddings")
    data = rows.toPandas()
    x, ids = np.array(data.embedding.tolist(), np.float64), data.vec_id.to_numpy()
    found = nearest.op4(rows).toPandas()
    hits = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(1))
        d[k] = np.inf
        own = found[found.query_id == ids[k]].sort_values("rank")
        hits += len(set(own.vec_id) & set(ids[np.lexsort((ids, d))[:10]]))
        total += 10
        at = {i: j for j, i in enumerate(ids)}
        assert own.score.tolist() == [d[at[v]] for v in own.vec_id] and own["rank"].tolist() == list(range(1, 11))
    assert hits >= 0.9 * total


def test_code_bounds_hold():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(500, 32)), rng.normal(size=(20, 32))
    c, turn = x.mean(0), nearest.rotation(32)
    low, high = nearest.bounds(*nearest.encode(x, c, turn), (q - c) @ turn)
    d = ((x[None] - q[:, None]) ** 2).sum(2)
    assert ((low <= d) & (d <= high)).mean() > 0.99


def test_url_rules_and_templates(spark):
    rows = ["http://a.example.com/de/1", "http://a.example.com/en/2", "http://x.net/a", "https://b.EXAMPLE.net/en/1?x#y", "http://fr.org/fr/", "http://x.net", "http://notexample.com/de/1", "http://a.org#/fr/"]
    rows += [f"http://z.com/{'ab'[k % 2]}/item-{k}" for k in range(60)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = (*urls.RULES, *(("block", f"z.com/a/item-{k}") for k in range(0, 40, 2)))
    found = {r["page_id"]: r for r in urls.judge(pages, rules).collect()}
    assert [found[k]["rule"] for k in range(8)] == ["example.com/de/", None, "net/", "example.net/en/", "org/fr/", None, None, None]
    assert [found[k]["verdict"] for k in range(6)] == ["block", "allow", "block", "allow", "allow", "allow"]
    assert found[8 + 58]["verdict"] == "block" and found[8 + 59]["verdict"] == "allow"


PAGE = """<!doctype html><html><head><title>x</title><script>var a="</p>"</script></head><body><header class="top"><h1>Site</h1></header><nav>menu</nav>
<div class="layout with-sidebar"><main><div class="cookie-notice">We use cookies</div><article class="post"><header><h1>Title {0}</h1><p class="byline">By me</p></header>
<p>One &amp; two&nbsp;three {0} with some more words to be read<p><b>Next {0} <i>para</i><br>line {0}<ul><li>a {0}<li>b {0}</ul><form>x</form><div class="share">Share</div><p>Standard policy.</p></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>nice post {0}</p></article></section></main><aside>side</aside></div><footer>foot</footer></body></html>"""


def test_html_article():
    want = "Title {0}\n\nOne & two three {0} with some more words to be read\n\nNext {0} para line {0}\n\na {0}\n\nb {0}"
    assert extract([PAGE.format(k) for k in range(5)]) == [want.format(k) for k in range(5)]
    assert extract([PAGE.format(1)]) == [want.format(1) + "\n\nStandard policy."]
    assert extract(["just text", "<p>unclosed <b", None]) == ["just text", "unclosed", ""]


def test_html_on_pages(table):
    from quillmark.llm import html

    for r in html.op9(table("pages")).join(table("pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        blocks = (" ".join(re.sub(r"<[^>]*>", " ", b).replace("&amp;", "&").replace("&quot;", '"').split()) for b in re.split(r"</?p>|</?h1>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pipeline_keeps_and_catches(spark, table):
    docs = table("documents").select("doc_id", "text", "lang", "source", "n_chars")
    copies = docs.limit(20).select((F.col("doc_id") + 10_000).alias("doc_id"), "text", "lang", "source", "n_chars")
    kept = {r["doc_id"] for r in simhash.deduplicate(docs.unionByName(copies)).select("doc_id").collect()}
    assert not any(k >= 10_000 for k in kept)
    assert language.documents_with_language(docs).count() >= 0.95 * docs.count()


def test_unlike_texts_under_one_id_stay(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4000, 100)) for _ in range(7)]
    rows = [(None, t) for t in texts[:4]] + [(3, texts[4]), (5, texts[5]), (5, texts[4] + " more"), (5, texts[5]), (None, texts[4]), (6, texts[6]), (6, None), (7, "")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([*rows[:6], *rows[9:11]], key=str)


def test_url_filter_is_native(spark, table):
    done = urls.op5(table("pages"))
    assert not re.search("Python|Pandas|Arrow", done._jdf.queryExecution().executedPlan().toString())
