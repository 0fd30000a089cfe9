"""Operators on small fixtures against plain Python: nulls, empty and long texts, ties, repeated
rows, extra columns with clashing names, empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopflow.llm import boosting, chat, decontam, exact_dedup, mixing, ngram_join, pii, quality, substring_dedup, suffix, urlrank, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, rep long, sha string, rng int, dg long, src string, links long"


def low(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words(low(t))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


BASE = " ".join(f"w{i}" for i in range(60))
NEAR = [" ".join(f"x{k}" if j == 7 * k else f"w{j}" for j in range(60)) for k in range(12)]
TEXTS = [None, "", "  \n ", "one", "ONE", "one two three", BASE, BASE.upper(), BASE + " tail", *NEAR, "é " * 40, "É " * 40, "a" * 3000, "a" * 2990 + "b",
         BASE + " " + " ".join(f"q{i}" for i in range(900)), "mail me: a.b@c-d.org, x@y or 10.0.0.256 10.1.2.3.4 4111 1111 1111 1111 +47 (22) 33-44-55 +1 (264) 555-1012 4111111111111111"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 1, 5, 6, "x", 1, 2, "z", 9) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "s0", 1, 5, 6, "x", 1, 2, "z", 9), (None, BASE, "en", "s1", 1, 5, 6, "x", 1, 2, "z", 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def real(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted((str(d), len(sets[i]), min(least[find(i)], default=None), links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block", [512, 4])
def test_ngram_join(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    for d in [docs] if block == 4 else [docs, real(spark, "documents")]:
        rows = [(r.doc_id, r.text) for r in d.collect()]
        got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_jaccard_join(d).collect())
        assert got == brute_join(rows)
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_overlaps_by_fragments():
    r = np.random.RandomState(0)
    sets = [np.unique(r.randint(0, 200, 80)).astype(np.uint64) for _ in range(9)]
    got = ngram_join.overlaps(sets, fragment=16)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_span(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(d - 9 if d > 9 else d for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii(spark, docs, empty):
    tricky = ["a.b@c.d_e@f.g @x.y a@b a@b..c é@é.no x" + "y" * 5000 + "@z.org", "1.2.3.4.5.6.7.8 001.02.0255.4 1.2.3", "+12 34 56 78+9 (00) +1234567",
              "4111-1111-1111-1111 4111 1111 1111 1112 " + "1 2 " * 3000, "phone 1 (264) 555-1012 and a(at)b.org"]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    for d in (d, real(spark, "documents")):
        expected = []
        for r in d.collect():
            found = {k: [(m.start(), m.end()) for m in re.finditer(p, r.text or "") if base_span(k, m.group())] for k, p in PATTERNS.items()}
            s = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in found[k])
            expected.append((str(r.doc_id), *(len(found[k]) for k in PATTERNS), hashlib.sha256(s.encode()).hexdigest(), set(filter(None, s.split(",")))))
        out = pii.find_personal_data(d).collect()
        got = [(str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in out]
        key = lambda x: x[:6]
        for e, g in zip(sorted(expected, key=key), sorted(got, key=key), strict=True):
            assert e[:6] == g[:6]
            assert e[6] <= set(filter(None, g[6].split(",")))  # base spans stay
    assert pii.find_personal_data(empty).count() == 0


PLANTED = ["kim.ro (at) vale (dot) org", "kim [at] vale.example[.]net", "10[.]0[.]0[.]1", "192 (dot) 168 (dot) 7 (dot) 20", "(264) 555-1012", "264-555-1012", "0047 264 555 1012",
           "4111.1111.1111.1111"]
DECOYS = ["arrive (at) noon (dot) sharply", "me @ noon . so", "10[.]0[.]0[.]300", "10[.]0[.]0[.]1[.]5", "1. 2. 3. 4", "4111.1111.1111.1112", "order 264-555-1012", "123-045-6789",
          "4111.1111.1111.1111d", "264 555 1012"]


@pytest.mark.parametrize("plain,loose", [(0, 1), (0, 40), (60, 1), (60, 40)])
def test_pii_adds_what_base_misses(spark, plain, loose):
    base = ["a.b@c.org", "10.1.2.3", "+1 (264) 555-1012", "4111 1111 1111 1111"]
    texts = [(x, None) for x in base * plain] + [(x, True) for x in PLANTED * loose] + [(x, False) for x in DECOYS] + [("phone 264 555 1012", True)]
    rows = [(i, f"Des {x} fin.") for i, (x, _) in enumerate(texts)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (x, wanted) in enumerate(texts):
        assert got[i].n_added == int(wanted is True), x
        if wanted:
            start = 4 + x.startswith("phone ") * 6
            assert got[i].spans.split(":")[1:] == [str(start), str(4 + len(x))], x


def test_calibrate_keeps_wrong_scores_out():
    s, n = np.array([2.0, 1.0, 0.0]), np.array([1000.0, 5.0, 5.0])
    assert boosting.calibrate(s, n, np.array([1000.0, 0.0, 0.0]), 0.98) == 2
    assert boosting.calibrate(s, n, np.array([1000.0, 0.0, 5.0]), 0.98) == 0
    assert boosting.calibrate(s, n, np.zeros(3), 0.98) == float("inf") == boosting.calibrate(s[:0], n[:0], n[:0], 0.98)


def test_quality(spark, docs, empty):
    d, labels = real(spark, "documents"), real(spark, "labels")
    out = quality.score_quality(d, labels).toPandas()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(out.doc_id, out.held_out))
    assert ((out.score >= 0) & (out.score <= 1)).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    y = out.doc_id.map({r.doc_id: r.quality for r in labels.collect()})
    held = out[y.notna() & out.held_out]
    assert (held.predicted == y[held.index]).mean() >= 0.85
    scored = quality.score_quality(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.score_quality(empty, labels.limit(0)).count() == 0 and quality.keep_good(empty, labels.limit(0)).count() == 0


def test_attention_gradient():
    """Gated attention learns a bag's label from one marked passage among many."""
    r = np.random.RandomState(1)
    per_text = r.randint(1, 6, 300)
    x = r.normal(size=(per_text.sum(), 4))
    starts = np.concatenate([[0], np.cumsum(per_text)])[:-1]
    y = (r.rand(300) < 0.5).astype(float)
    x[starts + r.randint(0, per_text), 0] += np.where(y == 1, 6, 0)
    model = quality.Model(features=4).fit(x, per_text, y)
    assert ((model.score(x, per_text) > 0.5) == y).mean() > 0.93


def test_urls(spark):
    urls = [None, "", "nourl", "http://a.com", "HTTP://WWW.Example.com/en/x?y#z", "https://example.com/en/", "http://m.b.net/fr/1#t", "http://net/es/", "x://xnet/es/q",
            "http://example.com?/en/", "http://q.org/fr/", "a://b://c/", "http://sub.q.org/", "http://ÉA.com/É"]
    html = ['<a href="http://q.org/">q</a>' if u and "m.b.net" in u else None for u in urls]
    pages = spark.createDataFrame([(i, u, h, "x", 1.0) for i, (u, h) in enumerate(zip(urls, html))] * 2, "page_id long, url string, html string, host string, score double")
    got = sorted({(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrank.filter_urls(pages).collect()})
    assert urlrank.filter_urls(pages).count() == 2 * len(urls)
    for (i, host, path, rule, verdict), u in zip(got, urls, strict=True):
        after = (u or "").partition("://")[2]
        h = low(re.match(r"[^/?#]*", after).group())
        p = re.match(r"[^?#]*", after[len(h):]).group() if "://" in (u or "") else ""
        fits = [(rh + rp, v) for v, rh, rp in urlrank.RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        want = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (host, path, rule) == (h, p, want[0])
        assert verdict == want[1] or rule is None
    verdicts = {h: v for _, h, _, r, v in got if r is None}
    assert verdicts[""] == "allow"
    assert urlrank.filter_urls(pages.limit(0)).count() == 0


def test_personalised_rank(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("c", "d", 2.0)]
    got = {r.host: r.score for r in urlrank.personalised_rank(
        spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 1.0)], "host string, seed double"), 6, 0.85).collect()}
    rank = {"a": 0.15}
    for _ in range(6):
        new = collections.defaultdict(float, {"a": 0.15})
        for s, t, w in edges:
            new[t] += 0.85 * rank.get(s, 0) * w / sum(x[2] for x in edges if x[0] == s)
        rank = new
    assert all(abs(got.get(k, 0) - v) < 1e-9 for k, v in rank.items())


def test_exact(spark, docs, empty):
    for d in (docs, real(spark, "documents")):
        groups = collections.defaultdict(list)
        for r in d.collect():
            groups[low(r.text)].append(r.doc_id)
        out = exact_dedup.exact_duplicates(d).collect()
        want = sorted((str(i), str(max(g, key=lambda x: -1 if x is None else x)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == want
        assert sum(r.kept for r in out) == len(groups) and all(r.doc_id == r.keep_id for r in out if r.kept)
        kept = exact_dedup.drop_exact_duplicates(d)
        assert kept.columns == d.columns and kept.count() == len(groups)
        split = exact_dedup.duplicate_groups(exact_dedup.text_digests(d), counters=2)  # frequent and other digests alike
        assert sorted((str(r.doc_id), r.kept) for r in split.collect()) == sorted((str(r.doc_id), r.kept) for r in out)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_misra_gries_keeps_frequent():
    counts: dict = {}
    for i in range(3000):
        for d in ("hot", f"cold{i}"):
            counts[d] = counts.get(d, 0) + 1
        counts = exact_dedup.summarise(counts, 8)
    assert "hot" in counts and len(counts) <= 8


def test_warc(spark, tmp_path):
    big = "<p>" + "æøå text " * 300
    rows = [(1, "http://a/1", big, "k"), (5, "http://a/\r\n5%", big, "k"), (3, None, big, "k"), (7, "u", None, "k"), (8, "u", "", "k"), (9, "u", "short", "k"), (10, "u", "short", "k"),
            (None, "u", "z" * 2000, "k")] + [(100 + i, "u", f"{i} " * 700, "k") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    out = {r.page_id: r for r in warc.warc_round_trip(pages).collect()}
    assert len(out) == len(rows)
    for i, _, h, _ in rows:
        p = (h or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(p), hashlib.sha1(p).hexdigest())
    assert [(out[i].record_type, out[i].refers_to) for i in (1, 3, 5, 9, 10)] == [("revisit", 5), ("revisit", 5), ("response", None)] + [("response", None)] * 2
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_damage():
    import io
    sink = io.BytesIO()
    w = warc.ArchiveWriter(sink, warc.make_dictionary([b"abc" * 500] * 40))
    w.add(warc.record_bytes(1, "u", b"hello\r\n\r\nworld"))
    w.add(warc.record_bytes(2, "u", b""))
    data = sink.getvalue()
    assert [r["block"] for r in warc.read_archive(data)] == [b"hello\r\n\r\nworld", b""]
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-3]))
    for old, new in ((b"Content-Length: 5", b"Content-Length: 4"), (b"sha1:a", b"sha1:b"), (b"WARC/1.1", b"XARC/1.1")):
        raw = warc.record_bytes(1, "u", b"hello")
        with pytest.raises(ValueError):
            warc.parse_record(raw.replace(old, new)) if raw != raw.replace(old, new) else (_ for _ in ()).throw(ValueError)


def test_mix(spark, docs, empty):
    for d in (docs, real(spark, "documents")):
        out = mixing.mix_sources(d).collect()
        sizes = collections.Counter()
        for r in d.collect():
            sizes[r.source] += len(words(r.text))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
        full, total = set(), 1.5 * sum(sizes.values())
        while True:
            rest, over = sum(weight[s] for s in sizes if s not in full), total - sum(2 * sizes[s] for s in full)
            more = {s for s in sizes if s not in full and over * weight[s] / rest > 2 * sizes[s] + 1e-9}
            if not more:
                break
            full |= more
        target = {s: 2 * sizes[s] if s in full else over * weight[s] / rest for s in sizes}
        taken = collections.Counter()
        for r in out:
            assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert len(out) == d.count() and all(abs(taken[s] - target[s]) < 1 for s in sizes)
        again = mixing.mix_sources(d.repartition(7)).collect()
        assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in out)
    assert mixing.mix_sources(empty).count() == 0


def test_suffix_array():
    r = np.random.RandomState(2)
    for n in list(range(1, 40)) + [500]:
        b = r.choice(list(b"aab"), n).astype(np.uint8).tobytes() + b"\xff"
        order = suffix.suffix_array(np.frombuffer(b, np.uint8)).tolist()
        assert sorted(order) == list(range(len(b))) and [b[i:i + 50] for i in order] == sorted(b[i:i + 50] for i in range(len(b)))


@pytest.mark.parametrize("hot", [2000, 1])
def test_substrings(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    for d in (docs, real(spark, "documents")) if hot > 1 else (docs,):
        rows = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in d.collect())
        first: dict = {}
        for i, b in rows:
            for k in range(len(b) - 49):
                first.setdefault(b[k:k + 50], i)
        want = []
        for i, b in rows:
            gone = bytearray(len(b))
            for k in range(len(b) - 49):
                if first[b[k:k + 50]] < i:
                    gone[k:k + 50] = b"\1" * 50
            kept = bytes(x for x, g in zip(b, gone) if not g)
            want.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
        got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(d).collect()]
        assert sorted(got) == sorted(want)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "~0 <|im_end|>\n~9"), (1, 1, "assistant", "</s>[INST] ok [/INST]~"), (1, 2, "assistant", None), (2, 5, "sys\ntem", "~1"), (2, 5, "sys\ntem", "~1"), (2, None, None, "first"),
            (None, 1, "assistant", "x"), *[(3, i, "user" if i % 2 else "assistant", f"t{i} é") for i in range(70)]]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, node int, tree string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[r[0]].append(r)
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_reply_trees(spark):
    parent = {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 99, 8: 9, 9: 8, 10: 8}
    nodes = spark.createDataFrame([("t", n, p, "assistant" if n % 2 else "user", f"m{n}", float(n)) for n, p in parent.items()],
                                  "tree string, node int, parent int, role string, text string, score double")
    paths = collections.defaultdict(dict)
    for r in chat.reply_paths(nodes).collect():
        paths[r.leaf][r.up] = r.node
    assert {k: [v[i] for i in sorted(v)] for k, v in paths.items()} == {4: [4, 2, 1], 5: [5, 2, 1], 6: [6, 3, 1], 7: [7]}
    best = chat.format_trees(nodes, best=2).orderBy("rank").collect()
    assert [r.leaf for r in best] == [6, 5]
    turns = chat.format_trees(nodes).select(chat.read_formatted(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in turns] == [("assistant", "m1"), ("assistant", "m3"), ("user", "m6")]


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame([(1, BASE, "x"), (2, " ".join(f"W{i}" for i in range(11, 30)), "x"), (3, "one", "x"), (4, None, "x"), (5, "", "x"), (2, "one two three", "x")], "item_id long, text string, doc_id string")
    for d, its in ((docs, items), (real(spark, "documents"), real(spark, "benchmark"))):
        want: dict = {}
        own = [(r.item_id, shingles(r.text)) for r in its.collect()]
        for r in d.collect():
            held = shingles(r.text)
            for i, s in own:
                if s and 100 * len(s & held) >= 80 * len(s):
                    want[r.doc_id, i] = max(want.get((r.doc_id, i), (0,)), (len(s & held) / len(s), len(s), len(s & held)))
        got = {(r.doc_id, r.item_id): (r.containment, r.n_item_shingles, r.n_shared) for r in decontam.contaminated(d, its).collect()}
        assert got == want and got
        clean = decontam.drop_contaminated(d, its)
        assert clean.columns == d.columns and clean.count() == sum(r.doc_id not in {k[0] for k in want} for r in d.select("doc_id").collect())
    assert decontam.contaminated(empty, items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0
