"""The training-data operators against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyrocline.llm import calibration, decontamination, hamming, markup, mixing, pages, quality, secrets, sharding, simhash, tokens, toxicity
from pyrocline.llm.common import small_enough
from pyrocline.llm.secret_rules import RULES, trigram_query, trigrams_of
from pyrocline.operators.components import connected_components
from pyrocline.storage import settle

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, n_chars long, size long, label int, body string, word string, target double, key long"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "en", 0, 5, 1, "b", "w", 0.5, 9) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (None, "the cat sat on the mat", None), (3, "   \n\t ", None), (4, "x", "b"), (4, "x", "b"), (5, "the cat sat on the mat", "b"),
       (6, "word " * 30_000, "c"), (7, "the cat sat on the mat", "c"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


# -- top-k search

def test_top_k_against_all_distances(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 256, (400, 8), dtype=np.uint8)
    base[50:120] = base[0]  # a common code
    base[120:200] = base[1] ^ (1 << draw.integers(0, 8, (80, 8))).astype(np.uint8) * (draw.random((80, 8)) < 0.3)
    ids = draw.permutation(400)
    codes = spark.createDataFrame([(int(i), bytearray(c)) for i, c in zip(ids, base, strict=True)] + [(900, None), (None, bytearray(8))], "id long, code binary")
    asked = codes.where("id % 20 = 0")
    found = {}
    for r in hamming.top_k(codes, asked, 12).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.distance, r.id))
    for i, c in zip(ids.tolist(), base, strict=True):
        if i % 20 == 0:
            far = np.bitwise_count(base ^ c).sum(axis=1)
            assert found[i] == sorted((int(d), int(j)) for d, j in zip(far, ids, strict=True) if j != i)[:12]
    assert hamming.top_k(codes.where("false"), asked.where("false"), 3).count() == 0
    assert hamming.top_k(codes.where("id in (1, 2)"), codes.where("id = 1"), 5).count() == 1


def test_search_ends_only_when_covered():
    draw = np.random.default_rng(3)
    codes = draw.integers(0, 256, (500, 4), dtype=np.uint8)
    index = hamming.SegmentIndex(codes)
    for query in draw.integers(0, 256, (20, 4), dtype=np.uint8):
        where, far = index.search(query, np.ones(500, np.int64), 7)
        true = np.sort(np.bitwise_count(codes ^ query).sum(axis=1))[:7]
        assert np.sort(far)[:7].tolist() == true.tolist() and len(set(where.tolist())) == len(where)


def test_sign_codes(spark):
    vectors = spark.createDataFrame([(1, [0.5, -1.0, 0.0, 2.0]), (2, None), (None, [1.0]), (3, [None, 1.0, 1.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.id, bytes(r.code)) for r in hamming.sign_codes(vectors).collect()) == [(1, b"\x09"), (3, b"\x06")]


# -- secrets

def brute_secrets(text):
    text, out = text or "", []
    for order, rule in enumerate(RULES):
        out += [(m.start(), order, m.end()) for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
    return sorted(out)


def test_secrets(spark):
    texts = ["password = \"hunter2hunter\" token:abcdefgh", "token=secret:abcdefgh", "TOKEN : short api_key='A1b2C3d4E5' apikey==12345678", "é" * 5 + "AKIA" + "A" * 12 + " AKIAAKIA0000",
             "0" * 31 + " " + "deadbeef" * 8 + "g" + "a" * 32, None, "", "passwd=x passwd=yyyyyyyy\npasswd=zzzzzzzzz", "ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY-----",
             "secret" + " " * 50 + "=" + "q" * 9000, "ſecret=12345678 toKen=12345678", "SeCrEt=" + "0123456789abcdef" * 3]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[0], "s"), (0, texts[0], "s")]
    found = secrets.scan_secrets(table(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, [tuple(x) for x in r.spans]) for r in found) == sorted((i is None, i or 0, brute_secrets(t)) for i, t, _ in rows)
    digest = {r.doc_id: r for r in secrets.digest(secrets.scan_secrets(table(spark, rows))).collect()}
    assert digest[5].base_sha256 == hashlib.sha256(b"").hexdigest() and digest[5].spans == ""
    assert digest[0].base_sha256 == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, _, b in brute_secrets(texts[0])).encode()).hexdigest()
    assert secrets.scan_secrets(table(spark, [])).count() == 0
    assert secrets.scan_secrets(table(spark, ODD)).count() == len(ODD)


def holds(query, grams):
    if query is True or isinstance(query, str):
        return query is True or query in grams
    return (all if query[0] == "and" else any)(holds(x, grams) for x in query[1])


def test_trigram_queries_let_no_match_go():
    samples = {"assign": ["API_KEY : 'abcdefgh1'", "passwd=12345678"], "access": ["AKIA" + "0" * 16], "private_key": ["-----BEGIN PRIVATE KEY-----"], "github": ["gho_" + "Z" * 40],
               "slack": ["xoxb-1234567890-a"], "google": ["AIza" + "x" * 35], "jwt": ["eyJhbGci.eyJzdWIi.c2lnbmF0dXJl"]}
    for rule in RULES:
        query = trigram_query(rule.pattern)
        assert (query is True) == (rule.kind == "hex")
        for text in samples.get(rule.kind, []):
            assert re.search(rule.pattern, text)
            assert holds(query, {text.lower()[i:i + 3] for i in range(len(text))})
    assert trigrams_of(trigram_query("abc|abcd")) == {"abc"}
    assert trigram_query("ab?") is True and trigram_query("(foo)+x*bar") == ("and", frozenset({"foo", "bar"}))


# -- toxicity and quality

def test_toxicity_finds_planted_words(spark):
    draw = np.random.default_rng(0)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(1200):
        words = list(draw.choice(vocabulary, 60))
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            words[draw.integers(60)] = str(draw.choice(["scoundrel", "wretch"]))
        rows.append((i, " ".join(words), "s"))
        marks.append((i, int(bad)))
    rows += [(5000, None, "s"), (None, "scoundrel wretch", "s"), (5001, "", "s"), (0, rows[0][1], "s")]
    known = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.score(table(spark, rows), known).collect()
    assert len(found) == len(rows)
    truth = dict(marks)
    for r in found:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == (truth.get(r.doc_id, 0) if r.doc_id is not None else 1)
    kept = toxicity.keep_ordinary(table(spark, rows), known)
    assert kept.columns == table(spark, []).columns and kept.count() == sum(1 - r.predicted for r in found)
    assert toxicity.score(table(spark, []), known).count() == 0
    blank = toxicity.score(table(spark, ODD), known.where("false")).collect()
    assert len(blank) == len(ODD) and not any(r.predicted for r in blank)


def plain_ratios(training, texts):
    """Ratios by the definition: class probabilities of every word that a context could have, one after the other."""
    words = lambda t: toxicity.words_of((t or "").encode())
    pairs, ends = {1: Counter(), 0: Counter()}, toxicity.SHARED_DISCOUNT
    for text, label in training:
        own = words(text)
        pairs[label].update(zip(["", *own], own, strict=False))
    both = pairs[0] + pairs[1]
    size = {c: sum(pairs[c].values()) for c in (0, 1)}
    count = {c: Counter() for c in (0, 1)}
    for c in (0, 1):
        for (_, w), n in pairs[c].items():
            count[c][w] += n
    kinds = Counter(w for _, w in both)
    known, unknown = sorted(kinds), "\0unknown"
    total, all_kinds = sum(size.values()), len(both)
    low = {w: max(kinds[w] - ends, 0) / all_kinds + ends * len(known) / all_kinds / (len(known) + 1) for w in [*known, unknown]}
    one = {w: max(count[0][w] + count[1][w] - ends, 0) / total + ends * len(known) / total * low[w] for w in low}
    assert sum(low.values()) == pytest.approx(1) and sum(one.values()) == pytest.approx(1)
    own, share = {}, toxicity.SHARED_WEIGHT
    for c in (0, 1):
        off = toxicity.CLASS_DISCOUNT * size[c] / min(size.values())
        gone = sum(min(n, off) for n in count[c].values()) / size[c]
        own[c] = {w: (1 - share) * (max(count[c][w] - off, 0) / size[c] + gone * one[w]) + share * one[w] for w in low}
        assert sum(own[c].values()) == pytest.approx(1)
    after = {}
    for (v, w), n in both.items():
        after.setdefault(v, {})[w] = n

    def probabilities(v, c):
        seen = after.get(v, {})
        n = sum(seen.values())
        shared = {w: (max(seen.get(w, 0) - ends, 0) + ends * len(seen) * low[w]) / n if n else one[w] for w in low}
        scaled = {w: p * own[c][w] / one[w] for w, p in shared.items()}
        return {w: p / sum(scaled.values()) for w, p in scaled.items()}

    memory = {}
    for text in texts:
        listed = words(text)
        sums = 0.0
        for v, w in zip(["", *listed], listed, strict=False):
            for c in (0, 1):
                if (v, c) not in memory:
                    memory[v, c] = probabilities(v, c)
                sums += (2 * c - 1) * np.log(memory[v, c].get(w, memory[v, c][unknown]))
        yield sums / len(listed) if listed else 0.0


def test_toxicity_ratios_by_definition(spark, tmp_path):
    draw = np.random.default_rng(5)
    word = lambda bad: str(draw.choice(["vile", "mean", "bad"])) if draw.random() < bad else f"w{int(draw.zipf(1.4)) % 60}"
    training = [(" ".join(word(0.1 if k % 4 == 0 else 0.0) for _ in range(draw.integers(1, 40))), int(k % 4 == 0)) for k in range(160)] + [("", 1), (None, 0), ("lone", 0)]
    texts = [" ".join(word(0.05) for _ in range(draw.integers(1, 30))) + " never seen" * (k % 2) for k in range(30)] + ["", None, "x", "vile", "vile vile", "word " * 30_000, "vile"]
    rows = spark.createDataFrame([(bytearray((t or "").encode()), x) for t, x in training], "body binary, label int").repartition(3)
    counts = toxicity.count_bigrams(rows)
    model = toxicity.fit_model(counts.cache())
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    wanted = list(plain_ratios(training, texts))
    assert max(wanted) > 0.001 > 0 > min(wanted)
    for limit in (toxicity.BROADCAST_WEIGHTS, -1):
        found = {r.doc_id: r.ratio for r in toxicity.with_ratio(frame, model, limit).collect()}
        assert [found[k] for k in range(len(texts))] == pytest.approx(wanted, abs=1e-9)
    one_class = toxicity.fit_model(toxicity.count_bigrams(rows.where("label = 1")).cache())
    assert all(r.ratio == 0 for limit in (10, -1) for r in toxicity.with_ratio(frame, one_class, limit).collect())


def test_bigram_counts(spark):
    rows = [(b"a b c", 1), (b"a b c", 1), (b"x b c", 0), (b"", 1), (b"a", 0)]
    found = toxicity.count_bigrams(spark.createDataFrame([(bytearray(b), x) for b, x in rows], "body binary, label int")).collect()
    names = {toxicity._word_hash(w): w for w in "abcx"} | {0: ""}
    assert {(names[r.prev], names[r.word]): (r.toxic, r.ordinary) for r in found} == {("", "a"): (2, 1), ("", "x"): (0, 1), ("a", "b"): (2, 0), ("x", "b"): (0, 1), ("b", "c"): (2, 1)}


def test_quality(spark):
    draw = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(800):
        words = ["".join(draw.choice(list("abcdefgh"), 5)) for _ in range(40)]
        good = i % 4 != 0
        rows.append((i, " ".join(words) if good else "!! ".join(w.upper() for w in words), "s"))
        marks.append((i, int(good)))
    known = spark.createDataFrame([*marks, (None, 1), (2, None)], "doc_id long, quality int")
    found = quality.score(table(spark, rows + ODD[:4]), known).collect()
    assert len(found) == 804
    truth = dict(marks)
    held = [r for r in found if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    right = [r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth and r.doc_id > 4]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert quality.score(table(spark, []), known).count() == 0
    assert quality.score(table(spark, ODD), known.where("false")).count() == len(ODD)


def test_normal_equations_are_the_sums(spark):
    draw = np.random.default_rng(2)
    stats, marks = draw.normal(size=(60, len(quality.STATISTICS))), draw.integers(0, 2, 60)
    kernel = quality.Kernel(stats.mean(0), stats.std(0))
    frame = spark.createDataFrame([(s.tolist(), int(m)) for s, m in zip(stats, marks, strict=True)], "stats array<double>, label int").repartition(5)
    whole = np.hstack([kernel.features(stats), marks[:, None]])
    assert np.allclose(quality._sums(frame, kernel), whole.T @ whole)
    near = kernel.features(stats)[:, 1:]
    level = (stats - stats.mean(0)) / stats.std(0)
    exact = np.exp(-quality.GAMMA * ((level[:, None] - level[None]) ** 2).sum(2))
    assert np.abs(near @ near.T - exact).max() < 0.35


def test_isotonic():
    assert [(round(a, 2), w) for *_, a, w in calibration.pool_adjacent(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1]))] == [(0, 1), (0.5, 2), (1, 1)]
    curve = calibration.fit_isotonic(np.arange(2000.0), (np.arange(2000) % 7 < np.arange(2000) / 300).astype(int))
    level = curve.values(np.arange(-10, 2010.0))
    assert (np.diff(level) > 0).all() and level.min() >= 0 and level.max() <= 1
    assert calibration.fit_isotonic(np.zeros(0), np.zeros(0)).values(np.zeros(1))[0] <= 0.01


# -- pages

def test_main_text(spark):
    page = ("<html><head><title>t</title></head><body class='has-sidebar'><nav>menu</nav><div class='ad'>buy</div><article class='p12'><header>up</header><h1>Title &amp; more</h1><p>one<br>two <b>three"
            "<p>f&ouml;ur</p><form>f</form><script>var a='</p>'</script><div class='comments'><p>bad</p></div></article><aside>x</aside><footer>end</footer>")
    bare = "<body><div class='c9'><p>only this text, which is the longest of the page</p></div><div id='cookie-notice'>yes</div></body>"
    rows = [(1, "http://h.com/1", page), (2, "https://u@h.com:80/2", page.replace("p12", "p7")), (3, None, bare), (4, "odd", None), (None, "http://h.com", ""), (5, "http://h.com/x", bare)]
    frame = spark.createDataFrame([(*r, 1, "p", "h") for r in rows], "page_id long, url string, html string, votes long, path string, host string")
    found = {r.page_id: r.text for r in pages.extract(frame).collect()}
    article = "Title & more\n\none two three\n\nför".replace("för", "föur")
    only = "only this text, which is the longest of the page"
    assert found == {1: article, 2: article, 3: only, 4: "", None: "", 5: only}
    assert {r.host: r.path for r in pages.winning_paths(frame).collect()}["h.com"] == "html>body.has-sidebar>article.p0"
    assert pages.extract(frame.where("false")).count() == 0


def test_main_text_is_the_whole_article(spark):
    body, lead = " ".join(["sentence of the body."] * 40), " ".join(["lead of it."] * 15)
    links = "<div class=x>" + "".join(f"<p><a href=/{k}>a linked title of another page {k}</a></p>" for k in range(9)) + "</div>"
    sources = [f"<body><article><h1>Headline</h1><div class=content><p>{body}</p></div></article>{links}</body>",
               f"<body><article><div class=lead><p>{lead}</p></div><div class=text><p>{body}</p></div></article></body>",
               f"<body><h1>Headline</h1><div class=a><div class=content><p>{body}</p></div></div>{links}</body>"]
    wanted = [f"Headline\n\n{body}", f"{lead}\n\n{body}"]
    assert [pages.main_text(s, None) for s in sources[:2]] == wanted
    assert pages.main_text(sources[2], None) == wanted[0]
    part = "html>body>article>div.text"  # a host's path that holds most of the article, but not its lead
    assert part.removeprefix("html>") in markup.parse(sources[1]).path and pages.main_text(sources[1], part.removeprefix("html>")) == wanted[1]
    frame = spark.createDataFrame([(k, "http://h.com/", sources[k % 2]) for k in range(8)], "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in pages.extract(frame).collect()} == {(k, wanted[k % 2]) for k in range(8)}


def test_forms_and_open_names():
    body = " ".join(["A sentence of the body."] * 30)
    form = f"<body><form id=aspnetForm><input name=q><div class=c><h1>Head</h1><p>{body}</p></div></form></body>"
    assert pages.main_text(form, None) == f"Head\n\n{body}"
    small = f"<body><article><p>{body}</p><form><p>Your mail here, please</p><button>go</button></form></article></body>"
    assert pages.main_text(small, None) == body
    for name in ("related-work", "foot-notes", "alert"):
        part = f"<body><article><h1>Head</h1><p>{body}</p><section class='{name}'><h2>Part</h2><p>Text of the part.</p></section></article></body>"
        assert pages.main_text(part, None) == f"Head\n\n{body}\n\nPart\n\nText of the part."
    for clutter in ("<div class=related-posts><a href=/a>another page</a><a href=/b>and one more</a></div>", "<div class=alert>Sale!</div>", "<section class=comments><h2>Two</h2><p>me too</p></section>",
                    "<div class=ad><p>buy this and that</p></div>", "<div class=cookie-alert><h2>We</h2><p>use cookies</p></div>"):
        assert pages.main_text(f"<body><article><p>{body}</p>{clutter}</article></body>", None) == body


def test_very_long_page():
    body = "word " * 400_000
    assert pages.main_text(f"<body><nav><a href=/>x</a></nav><article><p>{body}</p></article></body>", None) == body.strip()


@pytest.mark.parametrize(("source", "text"), [
    ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a\n\nb"), ("<div>1 < 2 & 3</div>", "1 < 2 & 3"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("<ul><li>a<li>b</ul>", "a\n\nb"), ("<p>cut <a hr", "cut"), ("<div><!-- x --><p>a&nbsp; b</p></div>", "a b"), ("<p><b>x<i>y</b>z</i></p>", "xyz"), ("<", "<")])
def test_forgiving_parser(source, text):
    assert markup.text_under(markup.parse(source)) == text


# -- tokens

def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary_path())
    odd = [(None, "null id"), (3, None), (-5, ""), (3, "again A.B, don't"), (9, "İx ΣΑΣ \x1cq <|endoftext|> a\0b K  "), (10, "long word " * 20_000)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 AS ids")
    found = tokens.encode_table(spark, frame, path=str(tmp_path / "t")).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    at, wanted = 0, []
    for doc_id, text in rows:
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4")
        wanted.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found), key=lambda x: x[1]) == wanted
    assert tokens.encode_table(spark, frame.where("false"), path=str(tmp_path / "e")).count() == 0


def test_short_document_access(spark, docs, tmp_path):
    path = str(tmp_path / "t")
    manifest = tokens.write_tokens(docs, path, tokens.vocabulary_path())
    first = manifest.orderBy("part").first()
    dictionary = tokens._dictionary(path)
    shard = tokens.Shard(path, first.file, dictionary)
    nth = list(shard)
    for k in (0, shard.docs - 1, shard.docs // 2):
        assert shard.read(k).tolist() == nth[k].tolist()
    assert len(dictionary) > 0
    with pytest.raises(ValueError, match="dictionary"):
        tokens.Shard(path, first.file, dictionary + b"x")


def test_encoding_tasks_store_no_tables(spark, docs, tmp_path, monkeypatch):
    stored = []
    monkeypatch.setattr(tokens, "settle", lambda df, label: stored.append(settle(df, label)) or stored[-1])
    path = str(tmp_path / "t")
    manifest = tokens.write_tokens(docs.repartition(9), path, tokens.vocabulary_path())
    assert manifest.count() > 1 and sum(len(x.inputFiles()) for x in stored) == 1
    # 300 small files are read back by few tasks, each whole and with its own base.
    many = manifest.crossJoin(spark.range(300 // manifest.count()).withColumnRenamed("id", "again"))
    found = tokens.read_tokens(many.drop("again"), path)
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert found.count() == docs.count() * (300 // manifest.count()) and found.distinct().count() == docs.count()


def test_small_sample_is_the_dictionary(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a few words"), (2, "and others")], "doc_id long, text string")
    dictionary = tokens.train_dictionary(frame, tokens.vocabulary_path())
    assert dictionary and tokens.train_dictionary(frame.where("false"), tokens.vocabulary_path()) == b""
    assert sorted(r.n_tokens > 1 for r in tokens.encode_table(spark, frame, path=str(tmp_path / "s")).collect()) == [True, True]


def test_encoder_without_shortcuts():
    own = tokens.Encoder(tokens.vocabulary_path("byte_bpe_50k.json"))
    assert not own.by_piece  # its tokens hold leading spaces
    texts = ["Hello  world\n", "", "a b"]
    assert [x.tolist() for x in own.ids(pa.array([t.encode() for t in texts], pa.binary()))] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_plain_words_go_straight_to_the_model(monkeypatch):
    own, passed = tokens.Encoder(tokens.vocabulary_path()), []
    monkeypatch.setattr(own, "_pieces", lambda pieces, slow=own._pieces: passed.extend(pieces) or slow(pieces))
    texts = ["Größe, aiché ciónmente!! the&&& ***", "the don't 3.14 Éa", "", "größe aïñß,*** 'tis (a) THE <|endoftext|> É'a the<| e\u0301"]
    wanted = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in own.ids(pa.array([t.encode() for t in texts], pa.binary()))] == wanted
    assert sorted(passed) == sorted({"don't", "3.14", "Éa", "'tis", "(a)", "<|endoftext|>", "É'a", "e\u0301"})


def test_encoder_against_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "_TOGETHER", 7)
    monkeypatch.setattr(tokens, "_TOGETHER_IDS", 20)
    own, draw = tokens.Encoder(tokens.vocabulary_path()), random.Random(6)
    signs = [*tokens._LETTERS, *tokens._LETTERS, *tokens._MARKS, *"ABÉÑẞ×÷ªº019", *" \n\t\x0b\x1c\0\xa0\x85\xad\u0301\u2003\u0130\u03a3Ж中😀ŁŃ", "<|endoftext|>", "'s", " the ", "</w>", "ing ", ". ", ",*** "]
    texts = ["".join(draw.choices(signs, k=draw.randrange(60))) for _ in range(3000)] + ["ab" * 5000, " ", ""]
    bodies = pa.array([t.encode() for t in texts], pa.binary())
    for at in (0, 1, 2990):
        assert [x.tolist() for x in own.ids(bodies[at:])] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at:]]
    assert list(own.ids(bodies[:0])) == [] and list(tokens._parts_of(bodies[:0])) == []
    # A vocabulary that doesn't show where words end, or that has a word of its own, is encoded without the shortcut.
    one = lambda text: own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.by_word and own._cuts_words(one)
    last, own.last = own.last, np.zeros_like(own.last)
    assert not own._cuts_words(one)
    assert [x.tolist() for x in own.ids(bodies[:50])] == [one(t) for t in texts[:50]]
    own.last = last
    own.tokenizer.add_tokens(["zebra"])
    assert not own._cuts_words(one)


# -- sharding

@pytest.mark.parametrize("copies", [0, 300])
def test_shards(spark, docs, copies):
    own = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + k, "the same text " * 40) for k in range(copies)] + [(None, None), (1, "x"), (1, "x")], "doc_id long, text string"))
    found = sharding.shard(own).toPandas()
    rows = own.collect()
    assert len(found) == len(rows)
    assert Counter(found["size"]) == Counter(len((r.text or "").encode()) + 8 for r in rows)
    assert Counter(found.text_crc32) == Counter(zlib.crc32((r.text or "").encode()) for r in rows)
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    held = found.groupby("shard")["size"].sum()
    assert len(held) == 24 and held.max() - held.min() <= 0.03 * held.mean()
    assert sorted(map(tuple, found.fillna(-1).itertuples(index=False))) == sorted(map(tuple, sharding.shard(own.repartition(7)).toPandas().fillna(-1).itertuples(index=False)))


def test_every_record_has_its_range(spark, docs):
    records = sharding._records(docs).cache()
    total = records.selectExpr("sum(size)").first()[0]
    cuts = sharding.splitters(records, 50, total).cache()
    keys = sorted(r.key for r in cuts.collect())
    found = sharding.find_range(records, cuts, 50).collect()
    assert len(found) == records.count() and all(r.part == sum(k <= r.key for k in keys) for r in found)
    assert 30 < len(keys) < 50


def test_few_shards(spark):
    assert sharding.shard(table(spark, [])).count() == 0
    assert sorted(tuple(r)[1:] for r in sharding.shard(table(spark, [(1, None, "s")]), 3).collect()) == [(8, 0, 0, 0)]
    assert sharding.deal([100, 10], 3, 25)[0] == [0, 1]
    assert sharding.deal([100, 10], 3, 25)[1] == [0, 8, 25] or sharding.deal([100, 10], 3, 25)[1][-1] == 25


# -- decontamination

def best_alignment(a, b):
    grid, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            grid[i, j] = max(0, grid[i - 1, j - 1] + (2 if x == y and x else -1), grid[i - 1, j] - 1, grid[i, j - 1] - 1)
            best = max(best, grid[i, j])
    return best


def test_alignment():
    draw = np.random.default_rng(4)
    for _ in range(40):
        a, b = draw.integers(1, 6, draw.integers(1, 15)), draw.integers(0, 6, draw.integers(1, 30))
        assert decontamination.align(a, b)[0] == best_alignment(a, b)


def test_contamination(spark):
    draw = np.random.default_rng(7)
    word = lambda: "".join(draw.choice(list("abcdefghij"), 6))
    items = [[word() for _ in range(n)] for n in (30, 45, 2, 20)]
    noise = lambda n: [word() for _ in range(n)]
    edited = [w if k % 6 else word() for k, w in enumerate(items[0])]
    cut = items[1][:20] + items[1][24:]
    rows = [(1, noise(50) + items[0] + noise(40)), (2, edited + noise(9)), (3, noise(30) + cut), (4, noise(80)), (5, items[1][:12] + noise(60)), (6, noise(3) + items[2]), (1, items[0]),
            (7, noise(3) + items[0] + noise(400) + items[3])]
    frame = table(spark, [(i, " ".join(w).title(), "s") for i, w in rows] + [(8, None, "s"), (None, " ".join(items[3]), "s")])
    bench = spark.createDataFrame([(n, " ".join(w), 1) for n, w in enumerate(items)] + [(9, None, 1), (10, "", 1), (None, "q", 1)], "item_id long, text string, doc_id long")
    found = Counter((r.doc_id, r.item_id) for r in decontamination.contaminated(frame, bench).collect())
    assert found == Counter({(1, 0): 2, (2, 0): 1, (3, 1): 1, (6, 2): 1, (7, 0): 1, (7, 3): 1, (None, 3): 1})
    left = decontamination.decontaminate(frame, bench)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == [4, 5, 8]
    assert decontamination.contaminated(frame, bench.where("false")).count() == 0
    assert decontamination.contaminated(frame.where("false"), bench).count() == 0


def test_search_finds_what_aligning_whole_texts_finds(spark):
    draw = np.random.default_rng(11)
    word = lambda: f"w{int(draw.zipf(1.2)) % 3000}"
    items = [[word() for _ in range(draw.integers(12, 50))] for _ in range(12)]
    edits = [lambda x, k=k: [w if i % k != k - 1 else word() for i, w in enumerate(x)] for k in (2, 3, 4, 5, 6)]
    edits += [lambda x, k=k: [w for i, w in enumerate(x) if i % k != k - 1] for k in (2, 3, 4)]
    edits += [lambda x, k=k: [x[i ^ 1] if i // 2 % k == 0 and i ^ 1 < len(x) else w for i, w in enumerate(x)] for k in (1, 2, 3)]
    edits += [lambda x: x[:len(x) // 2 + 1], lambda x: x[len(x) // 3:], lambda x: x]
    rows = [(n, " ".join([word() for _ in range(40)] + edit(item) + [word() for _ in range(draw.integers(5, 90))])) for n, (item, edit) in enumerate((i, e) for i in items for e in edits)]
    rows += [(5000, " ".join(word() for _ in range(60_000)) + " " + " ".join(items[0])), (None, " ".join(items[1])), (5001, None), (5002, "")]
    names = {w: n for n, w in enumerate(sorted({w for x in items for w in x}), 1)}
    code = lambda words: np.array([names.get(w, 0) for w in words], np.int64)
    wanted = {(n, o) for n, text in rows for o, item in enumerate(items) if decontamination.align(code(item), code((text or "").split()))[0] >= decontamination.THRESHOLD * 2 * len(item)}
    bench = spark.createDataFrame([(o, " ".join(x)) for o, x in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table(spark, [(n, t, "s") for n, t in rows]), bench).collect()}
    assert len(wanted) > 100 and found == wanted


def test_common_leak_is_found_everywhere(spark):
    item = "several quite rare words stand here in a row to be found again"
    rows = [(k, f"filler{k} " * 5 + item, "s") for k in range(60)] + [(100 + k, "nothing of the kind", "s") for k in range(20)]
    found = decontamination.contaminated(table(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == list(range(60))


# -- near-duplicates

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    values = np.array([p for _, p in prints], np.uint64)
    group = list(range(len(values)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2).tolist():
            a, b = root(i), root(j)
            group[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(doc_id, p, least.get(root(i))) for i, (doc_id, p) in enumerate(prints)]


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(i + 100_000 if i else None, t) for i, t, _ in ODD] + [(200_000, "A b  c É\x1cé")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(frame).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0)
    assert sorted(found, key=key) == sorted(brute_components([(i, brute_fingerprint(t)) for i, t in rows]), key=key)
    assert simhash.near_duplicates(frame.where("false")).count() == 0


@pytest.mark.parametrize("limit", [1, 6, 10**6])
def test_links_connect_what_all_pairs_connect(spark, limit):
    draw = np.random.default_rng(8)
    values = {int(v) for v in draw.integers(0, 1 << 63, 25, dtype=np.uint64)}
    for _ in range(700):
        v = sorted(values)[draw.integers(len(values))]
        for _ in range(draw.integers(1, 5)):
            v ^= 1 << int(draw.integers(64))
        values.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = simhash.links(frame, 2, limit)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in found.collect())
    got = {}
    for r in connected_components(found).collect():
        got.setdefault(r.component, set()).add(r.node)
    wanted = {}
    for v, _, least in brute_components([(v, v) for v in values]):
        wanted.setdefault(least, set()).add(signed(v))
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in wanted.values() if len(x) > 1}


def test_deduplicate(spark):
    kept = simhash.deduplicate(table(spark, ODD))
    assert kept.columns == table(spark, []).columns
    # Rows without words (1, 2, 3 and the null text without id) are one group, the three cats another.
    assert sorted((r.doc_id, (r.text or "")[:7]) for r in kept.collect()) == [(1, ""), (4, "x"), (5, "the cat"), (6, "word wo")]


def test_deduplicate_tells_rows_apart_by_id_and_text(spark):
    frame = table(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (2, "u v w x y z", "s"), (3, "k l m n o p", "s"), (3, "q q q r r r", "s")])
    assert sorted((r.doc_id, r.text[0]) for r in simhash.deduplicate(frame).collect()) == [(1, "a"), (2, "u"), (3, "k"), (3, "q")]


# -- mixing

def level_fill(sizes, weights):
    target, open_ = {}, set(sizes)
    left = float(sum(sizes.values()))
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if share * weights[s] > 3 * sizes[s]]
        if not full:
            return target | {s: share * weights[s] for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mix(spark, docs):
    own = docs.select("doc_id", "text", "source").unionByName(table(spark, ODD).selectExpr("doc_id + 50000 AS doc_id", "text", "source"))
    plan = mixing.plan_mix(own).toPandas()
    assert len(plan) == own.count()
    words = Counter()
    for r in own.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted((s for s in words if s is not None)) + [None]
    wanted = level_fill(dict(words), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    plan["source"] = plan.source.astype(object).where(plan.source.notna(), None)
    plan["taken"] = plan["size"] * plan.copies
    for source in order:
        part = plan[plan.source.isna()] if source is None else plan[plan.source == source]
        assert part.target.iloc[0] == pytest.approx(wanted[source]) and part.source_size.iloc[0] == words[source] == part["size"].sum()
        if len(part) > 3 and part["size"].max() * 8 < words[source]:
            assert part.taken.sum() == pytest.approx(wanted[source], abs=0.02 * words[source])
    assert plan.target.groupby(plan.source.fillna("~")).first().sum() == pytest.approx(sum(words.values()))
    assert plan.copies.between(0, 3).all()
    again = mixing.plan_mix(own.repartition(5)).toPandas()
    assert sorted(map(str, plan[["doc_id", "text_hash", "copies"]].values.tolist())) == sorted(map(str, again[["doc_id", "text_hash", "copies"]].values.tolist()))
    assert mixing.plan_mix(table(spark, [])).count() == 0


def test_extra_copies_know_nothing_of_size(spark):
    rows = [(k, "w " * (1200 if k % 6 == 0 else 40), f"s{k % 3}") for k in range(1500)]
    plan = mixing.plan_mix(table(spark, rows)).toPandas()
    checked = 0
    for _, part in plan.groupby("source"):
        ratio = part.target.iloc[0] / part.source_size.iloc[0]
        assert abs((part["size"] * part.copies).sum() - part.target.iloc[0]) <= 40
        if 0.1 < ratio % 1 < 0.9:
            checked += 1
            for size, own in part.groupby("size"):
                extra = (own.copies - int(ratio)).mean()
                assert abs(extra - ratio % 1) < 4 * (0.25 / len(own)) ** 0.5, size
    assert checked


def test_water_fill_caps(spark):
    rows = spark.createDataFrame([("a", 10, 5.0), ("b", 1000, 2.0), ("c", 40, 1.0), (None, 0, 5.0)], "source string, source_size long, weight double")
    found = {r.source: r.target for r in mixing.water_fill(rows).collect()}
    assert found == pytest.approx(level_fill({"a": 10, "b": 1000, "c": 40, None: 0}, {"a": 5, "b": 2, "c": 1, None: 5}))


def test_mix_repeats_rows(spark):
    rows = [(k, f"word{k} " * 10, "a") for k in range(30)] + [(100 + k, f"other{k} " * 10, "b") for k in range(200)]
    frame = table(spark, rows)
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(frame).collect()}
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in plan.items() if n})


def test_small_enough(spark):
    assert small_enough(spark.range(3), 3) and not small_enough(spark.range(4), 3)
