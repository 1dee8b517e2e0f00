"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and more columns."""

import base64
import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsafe.llm import html_extract, license_scan, media, minhash, mixing, packing, quality_rules, sharding, substring, warc
from docsafe.llm import _shared, _words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, part int, gid long, copies int, root long"


def made(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(70)
    texts = [None, "", "  \t\n", "one", "one", "One  two", "one two", text(6000), "x " * 300, "é ß " * 20]
    base = text(200).split()
    for i in range(n):
        if i % 5 == 0:
            w = list(base)
            for _ in range(i % 9):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif i % 5 == 1:
            texts.append(text(30) + "\n" + passage + "\t" + text(20))
        elif i % 5 == 2:
            texts.append(texts[-2])
        else:
            texts.append(text(r.randint(1, 160)))
    return [(i, t, "en", [None, "a", "b", "ü"][i % 4], len(t or ""), "clash", 3, 4, 5, 6) for i, t in enumerate(texts)]


def repeated(rows):
    """The rows with some that repeat a doc_id, with its text, another's or one of their own, or have none."""
    more = [(5, rows[20][1]), (5, rows[12][1]), (None, rows[12][1]), (None, None), (70, rows[12][1]), (70, rows[12][1]), (71, ""), (71, rows[30][1]), (5, "zz " + " ".join(f"q{i}" for i in range(130)))]
    return rows + [(i, t, *rows[0][2:]) for i, t in more]


def number(i):
    return -1 if i is None else i


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def twice(rows):
    return repeated(rows)


@pytest.fixture(scope="module")
def docs_twice(spark, twice):
    return spark.createDataFrame(twice, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return WORDS.findall(t or "")


def test_words(rows):
    texts = [r[1] for r in rows]
    w = _words.words(pa.array(texts))
    assert w.counts.tolist() == [len(split(t)) for t in texts]
    flat = [x for t in texts for x in split(t)]
    assert len(set(flat)) == len(np.unique(w.hashes()))
    assert dict(zip(flat, w.hashes().tolist(), strict=True)) == {x: h for x, h in zip(flat, w.hashes().tolist(), strict=True)}


def test_components(spark):
    links = spark.createDataFrame([(9, 3), (3, 7), (7, 8), (20, 21), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in _shared.components(links, "t").collect()}
    assert got == {9: 3, 3: 3, 7: 3, 8: 3, 20: 20, 21: 20}


def test_quality_statistics(spark, docs, rows, nothing):
    got = {r["doc_id"]: r for r in quality_rules.statistics(docs).collect()}
    for i, t, *_ in rows:
        w, lines, seen = split(t), (t or "").split("\n"), set()
        dup = 0
        for line in lines:
            if split(line):
                dup += line in seen
                seen.add(line)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out, found = quality_rules.decide(nothing.withColumns({"_t": F.lit(1), "kept": F.lit("x")}), labels)
    assert out.count() == 0 and found.rules == () and "_t" in out.columns and "words" in out.columns


def test_quality_learns(spark):
    r = random.Random(3)
    words = lambda k: " ".join(f"w{r.randrange(5000)}" for _ in range(k))
    rows = [(i, words(80) if i % 2 else words(80).replace("w1", "w1###"), i % 2) for i in range(300)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows] + [(None, 0), (3, None)], "doc_id long, quality int")
    out, found = quality_rules.decide(docs, labels)
    assert found.rules and {x["doc_id"] for x in out.where("not kept").collect()} == set(range(0, 300, 2))
    # every rule is precise on what the rules before it leave, and thresholds of bins and features agree
    stats = quality_rules.statistics(docs).join(labels.dropna(), "doc_id").toPandas()
    for rule in found.rules:
        took = stats
        for c in rule.conditions:
            took = took[took[c.feature] > c.threshold] if c.above else took[took[c.feature] <= c.threshold]
        assert len(took) >= 5 and (took.quality == 0).mean() >= 0.97
        stats = stats.drop(took.index)
    again, same = quality_rules.decide(docs.repartition(5).union(docs.limit(3)), labels)
    assert [str(r) for r in same.rules] == [str(r) for r in found.rules]


@pytest.mark.parametrize("how", [{}, {"run_rows": 5, "most_runs": 2, "fan_in": 2, "chunk": 2}])
def test_warc(spark, how):
    pages = [(i, f"http://www.h{i % 3}.org/é?q={i % 5}\n", ["<p>a</p>", None, "", "é\r\n\r\nWARC/1.1\r\n"][i % 4] if i % 7 else f"<b>{i}</b>", "x") for i in range(40)]
    pages += [(50, None, "own", "x"), (5, "u", "again", "x"), (5, "u", "again", "x"), (5, "v", "again", "x"), (5, "v", "else", "x"), (None, "n", "no id", "x"), (None, "n", "no id", "x"), (None, "", " p", "x"), (60, "a%20b ü", "q", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, archive string").repartition(3)
    got = warc.index(warc.read(spark, warc.write(df)), **how).collect()
    least = lambda i: -1 if i is None else i
    last = {}
    for i, _, h, _ in pages:
        last[h or ""] = max(least(i), last.get(h or "", -1))
    key = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = sorted((least(i), u if u is not None else "null", len((h or "").encode()), key(h or "")) for i, u, h, _ in pages)
    assert sorted((least(r["page_id"]), r["url"] if r["url"] is not None else "null", r["payload_bytes"], r["payload_digest"]) for r in got) == want
    answers = Counter(r["payload_digest"] for r in got if r["record_type"] == "response")
    assert set(answers.values()) == {1} and len(answers) == len(last)
    by_digest = {key(h): i for h, i in last.items()}
    for r in got:
        if r["record_type"] == "response":
            assert least(r["page_id"]) == by_digest[r["payload_digest"]] and r["refers_to"] is None
        else:
            assert least(r["refers_to"]) == by_digest[r["payload_digest"]]
    order = [(r["url_key"], r["captured"], least(r["page_id"]), r["archive"], r["record_offset"]) for r in got]
    assert order == sorted(order)
    if not how:
        path = warc.write(df.limit(0))
        assert warc.read(spark, path).count() == 0 and warc.index(warc.read(spark, path)).count() == 0
        alone = warc.read(spark, warc.write(df, least=5)).where("payload_bytes < 5")
        assert alone.where("record_type <> 'response'").count() == 0 and alone.count() == sum(len((p[2] or "").encode()) < 5 for p in pages)


def test_loser_tree():
    r = random.Random(2)
    for k in range(1, 9):
        runs = [sorted((r.randrange(50),) for _ in range(r.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for y in runs for x in y)
        tree, out = warc.LoserTree(), []  # runs that join on the way
        for x in sorted(runs):
            while (head := tree.least()) is not None and x and head < x[0]:
                out.append(tree.pop())
            tree.add(iter(x))
        assert out + list(tree) == sorted(x for y in runs for x in y)


def test_licences(spark, docs, nothing):
    texts = [*[t for v in license_scan.TEMPLATES.values() for t in v[:2]], "The driver has a licence.", None, "", "Released under the MIT License.\nfoo bar\nLicensed under CC BY-NC 4.0."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [x["family"] for x in r["licences"] if x["confirmed"]] for r in license_scan.scan(df).collect()}
    want = [[k] for k, v in license_scan.TEMPLATES.items() for _ in v[:2]] + [[], [], [], ["MIT", "CC-BY-NC"]]
    assert [got[i] for i in range(len(texts))] == want
    assert license_scan.scan(docs).where(F.size("licences") > 0).count() == 0 and license_scan.scan(nothing).count() == 0


def test_media(spark, docs, rows, nothing):
    path, archives = media.store(docs)
    loaded = media.load(spark, path, archives)
    got = {r["doc_id"]: r for r in media.features(loaded).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        want = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert by_text.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]
    path, archives = media.store(nothing)
    assert media.features(media.load(spark, path, archives)).count() == 0
    assert [media._uri(x) for x in ("s3a://b/a", "file:/a", "/a", "hdfs://h/a")] == ["s3://b/a", "file:///a", "file:///a", "hdfs://h/a"]


def test_media_retries():
    class Flaky:
        def __init__(self):
            self.tries = 0

        def seek(self, at):
            pass

        def read(self, n):
            self.tries += 1
            image = media.encode(b"\xff" * 576)
            whole = media.struct.pack(media.HEAD, media.MAGIC, 7, False, 0, len(image), zlib.crc32(image)) + image
            return whole if self.tries == 3 else whole[:-1]

    f = Flaky()
    assert media.member(f, 0, 10)[0] == 7 and f.tries == 3


def test_packing(spark, docs, rows, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = rows + [(1000 + i, x, *rows[0][2:]) for i, x in enumerate(["hello world <|endoftext|> x", "<|endoftext|><|endoftext|>", "<|endoftext", "<|padding|>"])]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), with_ids=True).toPandas()
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        p = got[got.doc_id == i].sort_values("start")
        assert [x for k in p.ids for x in k] == ids and set(p.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(np.array(k, "<u4").tobytes()) == c for k, c in zip(p.ids, p.ids_crc32, strict=True))
    total = 0
    for q, p in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert p.offset.tolist() == [0, *np.cumsum(p.length)[:-1]] and p.length.sum() <= 1024
        total += p.length.sum() == 1024
    assert total >= got.sequence_id.nunique() - 1
    assert packing.pack(nothing).count() == 0


def test_packing_repeats(docs_twice, twice):
    got = packing.pack(docs_twice).toPandas()
    whole = got.groupby([got.doc_id.fillna(-1), "sequence_id", "offset"]).length.sum()
    assert whole.sum() == got.length.sum() and got.length.sum() >= len(twice) and (got.start == 0).sum() == len(twice)


def test_sharding(docs_twice, twice, nothing):
    got = sharding.shard(docs_twice, shards=4).toPandas()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(zip(got.doc_id.fillna(-1), got["size"], got.text_crc32, strict=True)) == sorted((number(i), len((t or "").encode()) + 16, crc(t)) for i, t, *_ in twice)
    for _, p in got.groupby("shard"):
        assert sorted(p.slot) == list(range(len(p)))
    # groups of equal texts that fit a shard are whole
    shares = got.groupby("text_crc32").agg(size=("size", "sum"), words=("words", "sum"), n=("slot", "size"), shards=("shard", "nunique"))
    fits = (shares["size"] <= got["size"].sum() / 4) & (shares.words <= got.words.sum() / 4) & (shares.n <= len(got) / 4)
    assert (shares[fits].shards == 1).all()
    assert sharding.shard(nothing).count() == 0
    left = np.ones((40, 3))
    assert set(Counter(sharding.place(np.array([[0.1, 0.1, 0.1]] * 400), left).tolist()).values()) == {10}
    assert np.abs(left).max() < 1e-9


def test_sharding_balance(spark):
    """Lots of groups, one of them a third of all rows: bytes near equal."""
    r = random.Random(4)
    rows = [(i, "copy of one text" if i % 3 == 0 else "x" * r.randint(1, 400) + str(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, shards=8, fineness=16).groupBy("shard").agg(F.sum("size").alias("size")).toPandas()
    assert len(got) == 8 and got["size"].max() <= 1.02 * got["size"].mean() and got["size"].min() >= 0.98 * got["size"].mean()


def shingles(t, k):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("width", "block"), [(2, 512), (5, 3)])
def test_near_duplicates(docs_twice, twice, nothing, width, block):
    got = sorted((number(r["doc_id"]), r["n_shingles"], number(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(docs_twice, width=width, block=block).collect())
    sets = [shingles(r[1], width) for r in twice]
    root = {r[0]: r[0] for r in twice if r[0] is not None}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in enumerate(twice):
        for j in range(i):
            b = twice[j]
            both = len(sets[i] & sets[j])
            if a[0] is not None and b[0] is not None and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    want = sorted((number(r[0]), len(s), -1 if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0]) for r, s in zip(twice, sets, strict=True))
    assert got == want
    if block == 512:
        assert minhash.near_duplicates(nothing).count() == 0


def test_links():
    """Merged posting lists and exact sets against plain counts over all pairs of a block."""
    r = np.random.default_rng(1)
    base = r.integers(0, 50, 64, dtype=np.int32)
    sig = np.array([np.where(r.random(64) < r.choice([0.2, 0.45, 0.7]), r.integers(0, 50, 64), base) for _ in range(60)], np.int32)
    test = minhash._agree(38)(pa.chunked_array([pa.array(list(sig), pa.list_(pa.int32()))]))
    for p in range(60):
        rest = np.array([i for i in range(60) if i != p])
        assert sorted(test(p, rest)) == [i for i in rest if (sig[i] == sig[p]).sum() >= 38]
    sets = [np.unique(r.choice(120, r.integers(60, 110))).astype(np.uint64) for _ in range(40)]
    test = minhash._similar(50)(pa.chunked_array([pa.array([s.tobytes() for s in sets], pa.binary())]))
    for p in range(40):
        rest = np.array([i for i in range(40) if i != p])
        want = [i for i in rest if 100 * len(np.intersect1d(sets[i], sets[p])) >= 50 * len(np.union1d(sets[i], sets[p]))]
        assert sorted(test(p, rest)) == want


def test_near_duplicate_recall(spark):
    """Every true pair of similarity 0.8 or more, queries of ids divisible by 100 against all rows, has one component."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: shingles(t, 2) for i, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=2).collect()}
    pairs = [(i, j) for i in sets if i % 10 == 0 for j in sets if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(pairs) > 10 and sum(got[i] == got[j] for i, j in pairs) == len(pairs)


def test_html():
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=x>menu</a></nav><div class=\"cookie notice\">We use cookies</div><article><h1>Head &amp; line</h1><p><b>First   paragraph of the text, as long as one is.<br><p>Second one\n follows here, with words.</p></article><section class=\"comments\"><p>Nice!</p></section><aside class='sidebar'><ul><li><a>x</a></ul></aside><footer>&copy; me</foot"
    assert html_extract.main_text([page, None, "", "<p"]) == ["Head & line\nFirst paragraph of the text, as long as one is.\nSecond one follows here, with words.", "", "", ""]


def test_html_pages(spark):
    """The given pages against their marks: headings and paragraphs of the article, in order."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    mark = re.compile(r"<(/?)(h1|h2|p|li|blockquote|pre)\b[^>]*>", re.I)
    right = total = 0
    for r in pages.collect():
        body = re.search(r"<article\b[^>]*>(.*?)</article>", r["html"], re.S | re.I)
        if body is None:
            continue
        inner = re.sub(r"<(script|style|form|aside|figure)\b.*?</\1>|<!--.*?-->", " ", body[1], flags=re.S | re.I)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", x, flags=re.I))).split()) for x in mark.split(inner)[0::3]]
        total += 1
        right += [x for x in lines if x] == got[r["page_id"]].split("\n")
    assert total > 20 and right / total > 0.9


def test_html_rows(spark):
    page = "<nav><a href=x>Menu</a></nav><article><h1>A heading of it</h1><p>Some words of a long paragraph, which is text. <math><mi>x</mi></math> goes on.</p><svg><p>Then words after an svg that nobody closed, a whole sentence.</p></article>"
    rows = [(None, None, page, "t"), (1, "u", page, "t"), (1, "u", page, "t"), (2, "v", None, "t"), (3, "w", "", "t")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = {r["text"] for r in got if r["page_id"] not in (2, 3)}
    assert len(got) == 5 and len(texts) == 1 and all(x in texts.copy().pop() for x in ("x goes on.", "nobody closed"))
    assert all(r["n_chars"] == len(r["text"]) for r in got) and [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_html_held_out():
    from docsafe.llm import train_html

    made = [train_html.labelled(train_html.Maker(990_000_000 + i).page()) for i in range(120)]
    made = [x for x in made if x[0]]
    found = html_extract.Labeller.trained().scores([x[0] for x in made])
    right = sum(int(((s > 0.5) == (y > 0.5)).sum()) for s, (_, y) in zip(found, made, strict=True))
    assert right / sum(len(y) for _, y in made) > 0.97


def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs).toPandas()
    assert sorted(got.doc_id) == [r[0] for r in rows]
    size = {r[0]: len(split(r[1])) for r in rows}
    assert all(size[r.doc_id] == r.size for r in got[["doc_id", "size"]].rename(columns={"size": "n"}).assign(size=got["size"]).itertuples())
    total = got["size"].sum()
    per = got.assign(s=got.source.fillna("￿")).groupby("s").agg(S=("source_size", "first"), t=("target", "first"), k=("taken", "sum"))
    assert abs(per.t.sum() - total) < 1e-6 and (per.k - per.t).abs().max() <= 1 and (per.t <= 3 * per.S + 1e-9).all()
    weights = dict(zip(sorted(per.index), [1, 2, 3, 1], strict=False))
    free = [s for s in per.index if per.t[s] < 3 * per.S[s] - 1e-9]
    assert len({round(per.t[s] / weights[s], 6) for s in free}) <= 1
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mix(nothing).count() == 0
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns
    assert sum(len(split(r["text"])) for r in out.collect()) == got.taken.sum()


def test_mixing_repeats(spark, docs_twice, twice):
    """Rows of one doc_id, alike or not, and null beside empty sources: the curriculum reads what the mix takes."""
    rows = twice + [(90, "one two three", "en", "", 1, "clash", 3, 4, 5, 6), (90, "four five", "en", None, 1, "clash", 3, 4, 5, 6), (90, "four five", "en", None, 1, "clash", 3, 4, 5, 6), (90, "four five", "de", None, 1, "clash", 3, 4, 5, 6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows)
    taken = got.assign(s=got.source.fillna("null")).groupby("s").taken.sum().to_dict()
    read = Counter()
    for r in mixing.curriculum(df).collect():
        read["null" if r["source"] is None else r["source"]] += len(split(r["text"]))
    assert {k: v for k, v in taken.items() if v} == dict(read)


@pytest.mark.parametrize("most", [1 << 16, 4])
def test_substring(docs_twice, twice, nothing, most):
    first = {}
    for i, t, *_ in twice:
        w = split(t)
        for p in range(len(w) - 49 if i is not None else 0):
            k = tuple(w[p : p + 50])
            first[k] = min(i, first.get(k, i))
    want, left = [], []
    for i, t, *_ in twice:
        w = split(t)
        gone = {j for p in range(len(w) - 49) if first.get(tuple(w[p : p + 50]), i) < i for j in range(p, p + 50)} if i is not None else set()
        kept = [x for j, x in enumerate(w) if j not in gone]
        want.append((number(i), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
        left += [(number(i), kept)] if kept or not w else []
    got = [(number(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(docs_twice, most=most).collect()]
    assert sorted(got) == sorted(want)
    out = substring.deduplicate(docs_twice, most=most)
    assert out.columns == docs_twice.columns
    assert sorted((number(r["doc_id"]), split(r["text"])) for r in out.collect()) == sorted(left)
    if most > 4:
        assert substring.digests(nothing).count() == 0


def test_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = {}
        sparkContext = Cluster()

    with pytest.raises(RuntimeError):
        _shared.shared_dir(Session())


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in c.STAGES[:-1]:
        out = _shared.written(stage(spark, docs, sf), "stage")
        assert out.columns == docs.columns
        docs = out
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    pieces = c.STAGES[-1][1](spark, docs, sf)
    assert pieces.agg(F.sum("length")).first()[0] >= docs.count()


def test_pipeline_cases(spark, docs_twice):
    """Nulls, repeats and empty tables through every stage; rows of a doc_id are judged by their own text."""
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = docs_twice.select(*columns)
    for _, stage in c.STAGES[:-1]:
        docs = _shared.written(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
    assert c.STAGES[-1][1](spark, docs, sf).count() > 0
    kept = {(r["doc_id"], r["text"]) for r in c.quality(spark, docs_twice.select(*columns), sf).collect()}
    assert any(i == 5 for i, _ in kept) and all(len(split(t)) >= 50 for _, t in kept)


def test_pipeline_order(spark, tmp_path):
    """Sequences follow the order of the curriculum over files of unequal size."""
    import corpus_pipeline as c

    rows = [(i, "w " * (2000 if i % 7 == 0 else 3), "en", "s", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "docs")
    df.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    got = c.pack(spark, spark.read.parquet(path), "").where("start = 0").orderBy("sequence_id", "offset").collect()
    assert [r["doc_id"] for r in got] == list(range(60))
