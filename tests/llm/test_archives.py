"""Archives, the filter audit and the manifest against plain loops, with nulls, ties, repeated rows, clashing columns and empty tables."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from itertools import permutations

import pytest

from hairpin.llm import filter_audit, merkle, warc

PARTS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_parts(spark):
    """Files are dealt out in parts of 3,000 bytes, so records go over their borders."""
    before = spark.conf.get(PARTS)
    spark.conf.set(PARTS, "3000")
    yield
    spark.conf.set(PARTS, before)


def pages_of():
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abc é<>/\r\n") for _ in range(n))
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 12\r\n\r\nHello there.\r\n\r\n"
    html = [None, "", "x", say(99), say(100), "copy " * 40, "copy " * 40, "copy " * 39, say(5000), "WARC/1.1\r\n", inner, inner * 30, inner * 30, "a" + inner + "b", say(300) + "WARC/1.1\r\nContent-Length: 100000\r\n\r\n" + say(700)]
    html += ["WARC/1.1\r\n" * 200, inner[:-4] + "WARC/1.1\r\nContent-Length: 3\r\n\r\n", "\r\n\r\n" * 60, "WARC/1.1\r\nContent-Length: 7\r\n\r\n" + say(40) * 20]
    html += [say(rng.randint(0, 400)) for _ in range(40)]
    rows = [(k, f"http://a.example/{k} x\r\ny" if k % 5 else None, t) for k, t in enumerate(html, -3)]
    rows += [(None, "u", "copy " * 40), (None, "u", "copy " * 40), rows[20], rows[20], rows[5]]
    return rows


def roles(rows):
    out = []
    for page, _, text in rows:
        raw = (text or "").encode()
        same = [p for p, _, t in rows if p is not None and (t or "") == (text or "")]
        refers = min(same) if page is not None and len(raw) >= 100 and page > min(same) else None
        out.append((page, len(raw), sha256(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("files", [1, 3])
def test_archives_round_trip(spark, small_parts, tmp_path, files):
    rows = pages_of()
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, `my col` int, digest string").repartition(files)
    got = warc.round_trip(pages)
    assert sorted(map(tuple, got.collect()), key=str) == roles(rows)
    path = f"file://{tmp_path}/a{files}"
    warc.write(pages, path)
    back = warc.read(spark, path).collect()
    assert len(back) == len(rows) and all(r.intact for r in back)
    texts = {p: t for p, _, t in rows}
    for r in back:
        if r.record_type == "response" and r.page_id is not None:
            assert bytes(r.payload).decode() == (texts[r.page_id] or "")
        assert r.url == ("u" if r.page_id is None else f"http://a.example/{r.page_id}%20x%0D%0Ay" if r.page_id % 5 else None)


def test_archives_are_valid_files(spark, tmp_path):
    rows = pages_of()
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*")))
    at, n = 0, 0
    while at < len(data):
        assert data.startswith(b"WARC/1.1\r\n", at)
        header = data[at : data.index(b"\r\n\r\n", at)]
        at += len(header) + 4 + int(re.search(rb"\r\nContent-Length: (\d+)", header)[1])
        assert data[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(rows)


def test_entries_past_the_broadcast_bound(spark, small_parts, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_PARTS", 0)
    rows = pages_of()
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    assert sorted(map(tuple, got.collect()), key=str) == roles(rows)


def test_a_broken_archive_is_refused(spark, tmp_path):
    warc.write(spark.createDataFrame(pages_of(), "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/b")
    file = next((tmp_path / "b").glob("part-*"))
    for crc in (tmp_path / "b").glob(".*.crc"):
        crc.unlink()
    data = file.read_bytes()
    file.write_bytes(data[: len(data) // 2] + data[len(data) // 2 + 9 :])
    with pytest.raises(ValueError, match="don't follow"):
        warc.read(spark, f"file://{tmp_path}/b").count()


def test_archives_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def audit_by_loops(docs, labels):
    quality, toxic = {}, {}
    for d, q, t in [x for x in labels if x[0] is not None]:
        quality[d], toxic[d] = max(quality.get(d, -1), -1 if q is None else q), max(toxic.get(d, -1), -1 if t is None else t)
    fails = []
    for d, text, lang in docs:
        t = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        copy = d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in docs)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        fails.append((lang or "", {k for k, x in f.items() if x}, quality.get(d) == 1, toxic.get(d) == 1))
    out = set()
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        rows, total = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        out |= {(*r, total[r[1][r[2] - 1]]) for r in rows}
    return out


def test_filter_audit(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "é", "x1", "a|b", "\x1c"]) + str(rng.randint(0, 120))
    texts = [None, "", " \n", "short", "A", "É" * 10, "a#b", " ".join(f"w{i}" for i in range(99)), " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 79}" for i in range(100)), "A" + "b" * 9, "A" + "b" * 8, "x " * 3000]
    texts += [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(40)]
    docs = [(k, t, ("en", "de", None, "")[k % 4]) for k, t in enumerate(texts)]
    docs += [(200 + k, texts[k % 9], "en") for k in range(60)] + [(None, "short", "en"), (None, None, None), (3, "short", "de"), (3, "short", "de"), (-5, "a#b", "fr"), (-5, "a#b", "fr")]
    labels = [(k, (1, 0, None)[k % 3], (0, 1)[k % 2]) for k in range(0, 230)] + [(4, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*x, 5, "s") for x in docs], "doc_id long, text string, lang string, n int, digest string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(d, known)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 600 * 4 and set(rows) == audit_by_loops(docs, labels)
    assert filter_audit.audit(d.where("false"), known).count() == 0
    assert filter_audit.audit(d, known.where("false")).agg({"good_lost": "sum"}).first()[0] == 0


def manifest_by_loops(docs):
    h = lambda *x: sha256("".join(x).encode()).hexdigest()
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text: h(*[frame(d[c]) for c in ("doc_id", "source", "lang", "n_chars")], frame(text))

    def levels(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
            out.append(nodes)
        return out

    def siblings(tree, i):
        for nodes in tree[:-1]:
            a = i // 16 * 16
            yield nodes[a:i], nodes[i + 1 : a + 16]
            i //= 16

    sources, out = {}, []
    for d in docs:
        sources.setdefault(d["source"], []).append((d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"]), d))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, (*_, own, d) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            chosen = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0
            text = d["text"] and re.sub("[A-Z]", lambda m: m[0].lower(), d["text"])
            now = leaf(d, text) if chosen else own
            for left, right in path:
                now = h(*left, now, *right)
            out.append((d["doc_id"], own, trees[s][-1][0], top[-1][0], h(*[x for left, right in path for x in left + right]), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1], [300, 1, 2, 16, 31], [3] * 18 + [40]])
def test_manifest(spark, sizes):
    rng, docs = random.Random(sum(sizes)), []
    for s, n in enumerate(sizes):
        for i in range(n):
            text = rng.choice([None, "", "lower", "Upper É", "XYZ " * 50])
            docs.append({"doc_id": rng.randint(-50, 10**6) if i % 13 else (None, 7)[i % 2], "text": text, "lang": rng.choice([None, "en", ""]), "source": None if s == 1 else "" if s == 2 else f"É{s}", "n_chars": None if i % 5 == 0 else i})
    docs += [dict(docs[0])] * (3 if len(sizes) > 2 else 0)
    frame = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"], 1, "k") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, leaf int, `my col` string")
    got = sorted((tuple(r) for r in merkle.manifest(frame.repartition(6)).collect()), key=str)
    want = manifest_by_loops(docs)
    assert got == want
    assert any(not r[-1] for r in want) == any(r[-2] != r[3] for r in got)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")).count() == 0
