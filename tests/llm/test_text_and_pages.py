"""Personal data, secrets, pages, archives, toxicity and token ids."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import html_text as H, personal_data as P, pieces as T, secret_scans as C, toxicity as X, warc as W

DOCS = "doc_id bigint, text string"


def digits(value):
    return re.sub("[^0-9]", "", value)


def luhn(value):
    total = 0
    for i, c in enumerate(reversed(value)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
]


def test_base_spans_match_plain_patterns(spark):
    draw = random.Random(1)
    parts = ["a@b.co", "@", ".", "x.y", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "4111 1111-1111 1111", "4111111111111112", " ", "+49 (30) 123-4567",
             "+", "7", "é", "_d@e.f", "-", "\n", "@c.d..e", "5" * 25]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(400)]
    texts += ["1 " * 30_000 + "a" * 50_000 + "@b.c" + ".d" * 20_000, ""]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, None)]
    found = P.find_base(spark.createDataFrame(rows, DOCS)).collect()
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in found}
    for k, text in rows:
        want = [(kind, m.start(), m.end()) for kind, pattern, ok in PII for m in re.finditer(pattern, text or "") if ok(m[0])]
        assert got[k] == want, repr((text or "")[:200])


def plain_terms(text):
    """(start, end, term) of every term outside of what looks like a base value."""
    looks = "|".join(["(?<![A-Za-z0-9._%+-])" + PII[0][1].replace("(\\.", "(?:\\."), r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}", PII[3][1],
                      r"[0-9](?:[\x20-]?[0-9]){12,}"])
    return [(m.start(1), m.end(1), m[1].lower()) for m in re.finditer(looks + r"|([^\W_]{3,})", text or "") if m[1]]


def plain_added(rows):
    """(kind, start, end) added to each text, from all pairs of base values and terms of all distinct texts."""
    texts = sorted({t or "" for _, t in rows})
    terms = [{t for _, _, t in plain_terms(x)} for x in texts]
    holders, frequency = {}, {}
    for k, text in enumerate(texts):
        for kind, pattern, ok in PII:
            for m in re.finditer(pattern, text):
                if ok(m[0]):
                    holders.setdefault((kind, m[0]), set()).add(k)
        for t in terms[k]:
            frequency[t] = frequency.get(t, 0) + 1
    best = {}
    for held in holders.values():
        e, n = len(held), len(texts)
        for t, f in frequency.items():
            both = sum(t in terms[k] for k in held)
            if both < P.LEAST_TEXTS or both < f * P.LEAST_SHARE or e == n:
                continue
            share, usual = both / f, e / n
            bits = f * (share * math.log2(share / usual) + ((1 - share) * math.log2((1 - share) / (1 - usual)) if both < f else 0))
            told = math.log2(both * n / (e * f)) / math.log2(n / e)
            if told >= P.GENERALISE_AT - 1e-12 and bits >= math.log2(len(frequency) / P.RISK):
                best[t] = max(best.get(t, 0), told)
    kinds = {t: P.REMOVED if told >= P.REMOVE_AT else P.GENERALISED for t, told in best.items()}
    return {x: sorted((kinds[t] == P.GENERALISED, kinds[t], i, j) for i, j, t in plain_terms(x) if t in kinds) for x in texts}


def test_added_spans_match_all_pairs(spark):
    draw = random.Random(7)
    common = [f"word{c}" for c in "abcdefghijklmnop"]
    people = [(f"Name{c}", f"Road{c}", f"{c}@mail.org", f"10.0.0.{n}") for n, c in enumerate("qrstuv")]
    rows = []
    for k in range(400):
        words = draw.choices(common, k=12)
        if draw.random() < 0.2:
            name, road, mail, ip = draw.choice(people)
            words += [name, draw.choice([mail, f"{mail} {ip}"])] + [road] * (draw.random() < 0.8)
        if draw.random() < 0.02:
            words.append(draw.choice(people)[1])
        draw.shuffle(words)
        rows.append((k, " ".join(words) + draw.choice(["", ".", f" only{k}"])))
    # Exact copies count once, so the words of a copied text reveal nothing.
    rows += [(1000 + k, "copied passage unlike others copy@mail.org") for k in range(50)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, None), (2000, ""), (2001, "Roadq alone")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", digest string").withColumn("term", F.lit(1))
    want = plain_added(rows)
    assert {kind for spans in want.values() for _, kind, _, _ in spans} == {P.REMOVED, P.GENERALISED} and want["Roadq alone"]
    assert not want[rows[400][1]]
    got = sorted((str(r["doc_id"]), str([(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["number"] >= 4]))
                 for r in P.personal_data(docs).collect())
    assert got == sorted((str(k), str([x[1:] for x in want[t or ""]])) for k, t in rows)


def test_many_matches_in_one_text(spark):
    text = "x@y.zz 7 " * 30_000
    found = P.find_base(spark.createDataFrame([(1, text)], DOCS)).select(F.size("base"), F.col("base")[29_999]["end"]).first()
    assert tuple(found) == (30_000, 29_999 * 9 + 6)


def test_revealing_terms_are_marked_wherever_they_stand(spark):
    rows = [(k, f"case {k} of surname Zyxwvu reached at hidden@example.org during visit{k} number") for k in range(6)]
    rows += [(100 + k, f"ordinary text number {k} of a case reached during the visit at other{k}@example.org") for k in range(40)]
    rows += [(200, "Zyxwvu"), (201, None), (202, "")]
    docs = spark.createDataFrame(rows, DOCS)
    spans = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["spans"]] for r in P.personal_data(docs).collect()}
    for k in range(6):
        assert {v for kind, v in spans[k] if kind != "email"} == {"surname", "zyxwvu"}
    assert spans[200] == [(P.GENERALISED, "zyxwvu")] and spans[201] == spans[202] == []
    assert all(kind == "email" for k in range(100, 140) for kind, _ in spans[k])
    clean = {r["doc_id"]: r["text"] for r in P.sanitise(docs).collect()}
    assert clean[0] == "case 0 of  [word] reached at [email] during visit0 number" and clean[200] == "[word]"
    assert clean[201] is None and clean[202] == "" and clean[100].endswith("[email]")
    assert P.personal_data(docs.limit(0)).count() == 0


def test_secrets_and_ledger(spark, tmp_path):
    key = "ab" * 20
    rows = [
        ("p1", 1, f"token = \"{key}\" and AKIA{'Z' * 16} password=short secret:longer_value"), ("p2", 1, "token=secret: abcdefghij"),
        ("p3", 1, None), ("p4", 1, ""), ("p5", 1, f"x{key}"), ("p5", 2, f"x{key}"), ("p6", 1, f"x{key}"), ("p7", 1, "-----BEGIN RSA PRIVATE KEY-----"),
    ]
    versions = spark.createDataFrame(rows, "path string, version int, text string")
    ledger_path = str(tmp_path / "ledger")
    found = {(r["path"], r["version"]): [(s["kind"], s["value"]) for s in r["findings"]]
             for r in C.scan_versions(spark, versions, ledger_path).collect()}
    assert [k for k, _ in found["p1", 1]] == ["assign", "hex", "access", "assign"]
    assert found["p2", 1] == [] == found["p3", 1] == found["p4", 1]
    assert found["p5", 1] == found["p5", 2] == found["p6", 1] == [("hex", key)]
    assert [k for k, _ in found["p7", 1]] == ["pem"]
    ledger = spark.read.parquet(ledger_path)
    assert ledger.count() == 5
    # Nothing is scanned twice; another rule version scans everything again.
    C.update_ledger(spark, versions, ledger_path)
    assert spark.read.parquet(ledger_path).count() == 5
    more = versions.unionByName(spark.createDataFrame([("p8", 1, "new")], versions.schema))
    assert C.scan_unseen(more, ledger).count() == 1
    assert C.scan_unseen(versions, ledger, "next").count() == 5
    assert C.findings_by_path(versions.limit(0), ledger).count() == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    monkeypatch.setattr(H, "STEP", 4)
    draw = random.Random(1)
    for _ in range(500):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(14))] for _ in range(2))
        places, left = sorted(H.shared_places(a, b)), iter(b)
        assert len(places) == plain_lcs(a, b) and all(a[i] in left for i in places)


def test_lines_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="main">
    <header>Top</header><nav><ul><li>Menu</nav><div class="ad x">Buy</div><!-- <p>no</p> --><article><header><h1>Head&amp;line</h1></header>
    <p>One <b>t</b>wo&nbsp; three<br>four<p>A &lt; b<aside>Aside</aside><form>Form</form><span class="ads">Ad</span> end
    <section id="comments"><article>First!</article></section></article><div>open</div><footer>Foot</footer>"""
    assert [(k, t) for k, t in H.page_lines(page) if k != H.GONE] == [
        (H.STAYS, "Head&line"), (H.STAYS, "One two three"), (H.STAYS, "four"), (H.STAYS, "A < b"), (H.STAYS, "end"), (H.OPEN, "open")]
    assert H.page_lines(None) == H.page_lines("") == []
    assert H.page_lines("<p title='a>b") and H.page_lines("a < b")[0][1] == "a < b"


@pytest.mark.parametrize("page, want", [
    ("<article class='post has-sidebar'><p>Text</p></article>", ["Text"]),
    ("<main class='content no-comments'><p>Text</p></main>", ["Text"]),
    ("<div class='layout with-sidebar'><article>Text</article><div class='sidebar'>Side</div></div>", ["Text"]),
    ("<form action=x><input><div>Search</div><article>Text</article><nav>Menu<article>Teaser</article></nav></form>", ["Text"]),
    ("<article class='share-price'>Text</article>", ["Text"]),
    ("<article>Text<p class='ad'>Buy<p>More</p><p class=notice>Note</p><div>End</div></article>", ["Text", "More", "End"]),
    ("<article>Text<section><article class='comment'>First!</article></section><form>Mail<article>x</article></form></article>", ["Text"]),
    ("<aside><article>Teaser</article></aside><div class='site-header'>Top</div><article class='comment-body'>Me too</article>", []),
])
def test_articles_win_over_what_lies_around_them(page, want):
    assert [t for k, t in H.page_lines(page) if k != H.GONE] == want


def test_copies_of_open_pages_keep_their_text(spark):
    """Differencing decides here: no page has an article."""
    def page(k):
        return f"<div>Welcome</div><p>Own text {k}</p><p>second {k}</p><div>Terms</div>"

    rows = [(k, f"http://h.x/a/{k // 2}?copy={k % 2}", page(k // 2), "clash") for k in range(12)] + [(50, "http://h.x/a/3", page(3), "clash")]
    rows += [(k, f"http://two.x/{k}", "<p>the same everywhere</p>", "clash") for k in (60, 61, 61)]
    got = H.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        k = r["page_id"]
        assert r["text"] == ("the same everywhere" if k >= 60 else f"Own text {3 if k == 50 else k // 2} second {3 if k == 50 else k // 2}")


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_shared_open_lines_go(spark, partitions):
    rows = [(i, f"http://h{i % 2}.x/a/{i // 2:02d}", f"<div>Welcome</div><nav>m {i}</nav><p>Own text {i}</p><div>Terms</div>") for i in range(20)]
    rows += [(None, None, None), (99, "http://solo.y/", "<p>x&amp;y  z</p><p>only</p>"), (98, None, "<p>no url</p>")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
        got = {r["page_id"]: r["text"] for r in H.main_text(pages).collect()}
        assert got == {**{i: f"Own text {i}" for i in range(20)}, None: "", 99: "x&y z only", 98: "no url"}
        assert H.main_text(pages.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_loser_tree_merges():
    draw = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        sources = [sorted((draw.randrange(20), n) for n in range(draw.randrange(6))) for _ in range(k)]
        merged = list(W.LoserTree([iter(s) for s in sources], lambda row: row))
        assert merged == sorted(row for s in sources for row in s)


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://B.a.com:80/x?y#z", big), (3, "http://a.com/", big), (2, None, big), (4, "http://a.com/", "small"), (5, "http://a.com/\nq%0A", "small"),
            (6, "http://a.com/", None), (None, "http://a.com/", big), (7, "x", "z" * 1000), (7, "x", "z" * 1000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    index = W.write_archives(W.decide(pages), str(tmp_path / "a"), archive_bytes=300)
    merged = W.merge_runs(index, range_rows=4)
    lines = [tuple(r) for r in merged.orderBy("range_no").select(*W.ORDER).collect()]
    assert lines == sorted(lines, key=lambda r: (r[0].encode(), r[1], r[2] is not None, r[2] or 0, r[3], r[4]))
    records = W.read_archives(merged, str(tmp_path / "a")).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    got = sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records), key=str)
    want = [(i, u, len((h or "").encode()), sha(h), *(("revisit", 3) if h == big and i != 3 else ("response", None))) for i, u, h in rows]
    assert got == sorted(want, key=str)
    assert {r["html"] for r in records if r["record_type"] == "response"} == {big, "small", "", "z" * 1000}
    none = W.write_archives(W.decide(pages.limit(0)), str(tmp_path / "b"))
    assert W.read_archives(W.merge_runs(none), str(tmp_path / "b")).count() == 0


def test_url_keys(spark):
    urls = {"https://www.A.com/P?q=1#f": "com,a,www)/p?q=1", "//u:p@a.b:8/": "b,a)/", "": "", None: ""}
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["k"] for r in frame.select("u", W.url_key(frame["u"]).alias("k")).collect()} == urls


def test_toxic_texts_are_told_apart_on_held_out_rows(spark):
    draw = random.Random(7)
    plain = [f"word{k}" for k in range(300)]
    nasty = ["vile", "rotten", "scoundrel", "wretchedly", "wretchedness", "beastly"]
    rows, labels = [], []
    for k in range(1500):
        words = [draw.choice(plain) for _ in range(40)]
        toxic = k % 8 == 0
        if toxic:
            for w in draw.sample(nasty, 3):
                words.insert(draw.randrange(40), w)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "vile rotten beastly")]
    docs, given = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = X.train(docs, given)
    got = X.score_texts(docs, model).collect()
    held = [(r["score"], r["predicted"], r["doc_id"] % 8 == 0) for r in got if r["held_out"] and (r["doc_id"] or 0) < 1500 and r["doc_id"] is not None]
    assert len(held) > 350 and all(bool(p) == t for _, p, t in held)
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["score"] == by[5001]["score"] < 0.3 and by[None]["score"] > 0.7 and not by[None]["held_out"]
    # Held-out labels change nothing.
    flipped = given.withColumn("toxic", (given["toxic"] + X.held_out(given["doc_id"]).cast("int")) % 2)
    assert X.train(docs, flipped).weights.tolist() == model.weights.tolist()
    assert len({r["score"] for r in X.score_texts(docs, X.train(docs, given.limit(0))).collect()}) == 1
    assert X.score_texts(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("chunk", [40, 200, T.CHUNK])
def test_ids_are_those_of_the_library(spark, tables, chunk):
    texts = [r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").limit(25).collect()]
    texts = [t[:1500] for t in texts] + [t.replace(" ", "")[:400] for t in texts[:5]]
    texts += ["a" * 300, "    " * 80, "漢字☃" * 60, "<0x0A>" * 40, "▁▁x" * 40, "internationalization" * 15 + "𝔘" * 5, "", " ", None]
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], DOCS)
    model = T.load(T.MODEL)
    rows = T.encode_and_decode(docs, chunk=chunk).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"] or 0]
        assert r["ids"] == (None if text is None else model.library.encode(text)), repr(text)
        assert r["round_trip"] is (None if text is None else True)
    decoded = {r["doc_id"]: r["text"] for r in T.decode_ids(T.encode_texts(docs, chunk=chunk).drop("text")).collect()}
    assert all(decoded[k if k else None] == (t if t is None else t.replace("▁", " ")) for k, t in enumerate(texts))
    assert T.encode_and_decode(docs.limit(0), chunk=chunk).count() == 0


def test_transfer_matrices_combine_associatively():
    model = T.load(T.MODEL)
    text = T.marked("internationalizationofthe" * 8)
    cuts = [0, 37, 80, 121, len(text)]
    parts = []
    for begin, end in zip(cuts, cuts[1:]):
        before, after = text[max(0, begin - model.longest):begin], text[end:end + model.longest]
        entries = model.states_at(before, text[begin:end] + after) if begin else [T.START]
        parts.append(T.transfer(model, text[begin:end], after, entries))
    left = T.combine(T.combine(parts[0], parts[1]), T.combine(parts[2], parts[3]))
    right = T.combine(parts[0], T.combine(parts[1], T.combine(parts[2], parts[3])))
    assert left == right and left
