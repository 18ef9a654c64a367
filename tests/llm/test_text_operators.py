import hashlib
import random
import re

import numpy as np
import pytest

from lodestone.llm import chat, html_extract, langid, toxicity, winnowing

LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
OTHER = "schnell wald berg strasse zwischen himmel wasser fluss zeit wort haus freund welt jahr leben licht nacht".split()


def test_winnowing_equals_brute_force(spark):
    r = random.Random(1)
    texts = ["", None, "!!!", "one", "One two", "a" * 5000, "Ünï çødé ☃ text"] + [" ".join(r.choice(LATIN) for _ in range(r.choice([3, 10, 100, 300]))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as hashes", "2 as prints_t").repartition(3)
    every = _all(spark, [t or "" for t in texts])
    for w in (1, 4, 5, 8):
        got = {x.doc_id: [(p.hash, p.pos) for p in x.prints] for x in winnowing.fingerprints(df, window=w).collect()}
        for i, t in enumerate(texts):
            assert got[i] == _winnowed(every[t or ""], w), (w, t)


def _winnowed(every, w):
    want = []
    for a in range(max(1, len(every) - w + 1)):
        low = min(h for h, _ in every[a : a + w])
        pick = max((h, p) for h, p in every[a : a + w] if h == low)
        if pick not in want:
            want.append(pick)
    return want


def _all(spark, texts):
    """text -> all (hash, position) of its k-grams, from tokens and grams that are hashed one a row."""
    from pyspark.sql import functions as F

    tokens = {t: re.findall(rf"[^\W_]{{1,{winnowing.TOKEN}}}", t.lower()) or [t] for t in texts}
    words = spark.createDataFrame([(w,) for w in sorted({w for x in tokens.values() for w in x})], "w string")
    at = {r.w: r.h for r in words.select("w", F.xxhash64("w").alias("h")).collect()}
    runs = {t: [tuple(at[w] for w in x[i : i + 3]) + (None,) * (3 - len(x)) for i in range(max(1, len(x) - 2))] for t, x in tokens.items()}
    grams = spark.createDataFrame(sorted({g for x in runs.values() for g in x}, key=str), "a long, b long, c long")
    mixed = {(r.a, r.b, r.c): r.h for r in grams.select("*", F.xxhash64(F.xxhash64("a", "b"), "c").alias("h")).collect()}  # a missing token is a null, which only hashes once more
    return {t: [(mixed[g], i) for i, g in enumerate(x)] for t, x in runs.items()}


def test_edit_and_next(spark):
    texts = {7: "abcdefghij", 5: "xy", 1: None, 0: "😀" * 7, 12: "Zz zz"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in winnowing.compare_with_edit_and_next(df).collect()}
    order = sorted(texts, reverse=True)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[a] or "", texts[b] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (got[a].n_chars, got[a].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= got[a].near_edited <= 1
    one = winnowing.compare_with_edit_and_next(df.where("doc_id = 7")).first()
    assert one.near_next == 1.0
    assert winnowing.compare_with_edit_and_next(df.where("false")).count() == 0
    many = spark.range(5000).selectExpr("id * 3 as doc_id", "concat('text ', id) as text").unionByName(spark.createDataFrame([(None, "n"), (3, "dup")], "doc_id long, text string"))
    assert winnowing.compare_with_edit_and_next(many).count() == 5002


def test_likeness_equals_brute_force_at_every_length(spark):
    words = [f"w{i}" for i in range(80)]
    texts = {i: " ".join(words[: 80 - i]) for i in range(80)}
    got = {r.doc_id: r for r in winnowing.compare_with_edit_and_next(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    following = {i: texts[(i - 1) % 80] for i in texts}
    changed = {i: t[: len(t) - len(t) // 2] + following[i][: len(t) // 2] for i, t in texts.items()}
    every = _all(spark, [*texts.values(), *changed.values()])
    prints = lambda t: {h for h, _ in _winnowed(every[t], 4)}
    for i, t in texts.items():
        for other, likeness in ((following[i], got[i].near_next), (changed[i], got[i].near_edited)):
            assert likeness == len(prints(t) & prints(other)) / len(prints(t) | prints(other))
    assert min(got[i].near_next for i in range(1, 60)) > 0.85  # no jump at any length


def test_ids_of_any_spread_keep_their_order_in_small_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = random.Random(3)
    spreads = {
        "hashed": [r.randrange(-(2**63), 2**63) for _ in range(3000)] + [-(2**63), 2**63 - 1], "outlier": [*range(3000), 10**15], "two ranges": [*range(1500), *range(10**12, 10**12 + 1500)],
        "hot id": [7] * 2000 + [*range(100, 600)] + [None] * 500}
    for name, ids in spreads.items():
        rows = [(i, f"text {k}") for k, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = winnowing.with_next(df, per_bucket=100).where("_copy = 0").collect()
        hashed = {x.text: x.h for x in df.select("text", F.xxhash64("text").alias("h")).collect()}
        order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), -hashed[x[1]]))
        follows = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
        assert {x.text: x.next_text for x in got} == follows, name
        sizes = {}
        for x in got:
            sizes[x._bucket] = sizes.get(x._bucket, 0) + 1
        assert max(sizes.values()) <= 250, name


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, None, None), (1, 1, "assistant", "<turn user>\\s\\l\\\\"), (1, 1, "assistant", "😀"), (None, 5, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 as node", "1 as up")
    got = {r.conv_id: r for r in chat.digest(chat.formatted(chat.linear_tree(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[-7].n_turns, got[-7].turns_sha256) == (2, sha(f"user\n{said}\nassistant\n{said}\n"))
    assert (got[-7].loss_chars, got[-7].loss_sha256) == (len(said), sha(said))
    assert got[1].n_turns == 3 and got[1].loss_sha256 == sha("<turn user>\\s\\l\\\\😀") and got[None].n_turns == 1
    assert chat.formatted(chat.linear_tree(df.where("false"))).count() == 0


def test_chat_roles_may_hold_marks_and_conversations_may_be_long(spark):
    texts = [f"{i} \\g \\s <turn a> > é😀 " * (i % 5) for i in range(3000)]
    rows = [(1, i, ("a>b", "</turn>", "\\g>", "assistant")[i % 4], t) for i, t in enumerate(texts)] + [(2, 0, "a>b", "hello"), (3, 0, "assistant", "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.formatted(chat.linear_tree(df))
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in done.withColumn("turns", chat.read_turns("formatted")).collect()}
    assert turns[1] == [(r, t) for _, _, r, t in rows[:3000]] and turns[2] == [("a>b", "hello")]
    got = {r.conv_id: r for r in chat.digest(done).collect()}
    said = "".join(t for i, t in enumerate(texts) if i % 4 == 3)
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest()) and got[3].loss_chars == 1_000_000 and got[2].loss_chars == 0


def test_best_branch_of_a_tree(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "thanks", 0.5), (1, 5, 99, "user", "orphan", -1.0), (1, 6, 7, "user", "c", 9.0), (1, 7, 6, "user", "c", 9.0)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    try:
        chat.paths(df, most=6)
        raise AssertionError("a cycle must fail")
    except ValueError:
        pass
    tree = df.where("node < 6")
    out = chat.formatted(tree, branches=2).orderBy("branch").collect()
    assert [r.branch for r in out] == [1, 2] and "good" in out[0].formatted and "thanks" in out[0].formatted and "bad" in out[1].formatted


def test_html():
    page = '<body><header>Site</header><div id="cookie-notice">We use cookies</div><article><header><h1>T</h1></header><p>Hello &amp; <b>world</b></p><aside>x</aside><form>y<input></form><div class="comments"><p>First!</p></div><ul><li><a href=x>related link</a></li></ul><p>a&lt;b<script>1<2</script></p></article><div class="sidebar">z</div></body>'
    assert html_extract.main_text(page) == "T\n\nHello & world\n\na<b"
    long = "the man was in the house and it was on the hill, as he had been there with his dog for a year " * 3
    plain = f"<div>Home | News</div><p>{long}</p><p>Short one.</p><p>{long}</p><div><a href=a>link</a> <a href=b>other</a></div>"
    assert html_extract.main_text(plain) == "\n\n".join([long.strip(), "Short one.", long.strip()])
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") * 0
    for broken in ("<", "<p><b", "</p></p>", "<!-- x", "<script>", "<a <b>", "&#xD800; &bogus; <p>x"):
        html_extract.main_text(broken)


def test_blocks_inherit_from_their_nearest_neighbours():
    r = random.Random(5)
    for _ in range(300):
        found = [html_extract.Block(r.choice([0, 0, 1]), r.random() < 0.1, r.random() < 0.15, evidence=r.uniform(-1, 3), text="x") for _ in range(r.randint(0, 25))]
        for b in found:
            b.label = r.choice(["good", "bad", "ambiguous", "ambiguous"])
        first = [b.label for b in found]
        html_extract.second_pass(found)
        for i, b in enumerate(found):
            if first[i] != "ambiguous":
                assert b.label == first[i]
                continue
            region = [j for j, x in enumerate(found) if x.root == b.root and not x.area]
            sure = [j for j in region if first[j] != "ambiguous"]
            edge = "good" if b.root else "bad"
            if b.area:
                assert b.label == ("good" if b.evidence >= html_extract.RULES.middle else "bad")
                continue
            at = region.index(i)
            near = sorted([(abs(region.index(j) - at), first[j]) for j in sure] + [(at + 1, edge)] * (not any(j < i for j in sure)) + [(len(region) - at, edge)] * (not any(j > i for j in sure)))
            own = "good" if b.evidence >= html_extract.RULES.middle else "bad"
            before = ([first[j] for j in sure if j < i] or [edge])[-1]
            after = ([first[j] for j in sure if j > i] or [edge])[0]
            clear = b.evidence >= 1.25 or b.evidence <= 0.45
            want = before if sure and before == after else own if not sure or clear or len({x for d, x in near if d == near[0][0]}) != 1 else near[0][1]
            after = [j for j in region if j > i]
            if b.heading and after and not b.area:
                want = found[after[0]].label
            assert b.label == want


def test_ambiguous_blocks_may_turn_bad():
    links = "".join(f"<p><a href=x>more of the news and of the day number {i}</a></p>" for i in range(3))
    long = "the man was in the house and it was on the hill, as he had been there with his dog for a year " * 3
    page = f"<article><p>{long}</p>{links}<p>Xylophone quartz</p>{links}</article>"
    assert html_extract.main_text(page) == long.strip()
    assert [b.label for b in html_extract.classified(page)] == ["good"] + ["bad"] * 7


PROSE = "the man was in the house and it was on the hill, as he had been there with his dog for a year. " * 3


@pytest.mark.parametrize("frame", ['<div class="layout has-sidebar"><article>{}</article></div>', '<div id="search-results-page"><main>{}</main></div>', "<form action=x><div><article>{}</article></div></form>",
                                   '<div class="sidebar-page"><form><article>{}</article></form></div>', '<div class="sidebar">{}</div>', '<div class="modal"><article>{}</article></div>'])
def test_a_frame_is_no_area(frame):
    page = '<body><div class="ad"><p>Buy it now</p></div>' + frame.format(f"<p>{PROSE}</p>") + '<div class="comments"><article><p>' + PROSE + PROSE + "</p></article></div></body>"
    assert html_extract.main_text(page) == PROSE.strip()


@pytest.mark.parametrize("area", ['<div class="sidebar"><article>{}</article></div>', '<div class="promo">{}</div>', "<form>{}</form>", '<div class="comment-list"><article>{}</article></div>', "<nav><article>{}</article></nav>", '<div class="advert">{}</div>'])
def test_an_area_beside_the_article_stays_one(area):
    page = f"<body><article><p>{PROSE}</p></article>" + area.format(f"<p>{PROSE[:120]}</p>") + "</body>"
    assert html_extract.main_text(page) == PROSE.strip()
    assert html_extract.main_text('<body><div class="advert"><p>' + PROSE + "</p></div></body>") == ""


def test_self_closed_tags():
    assert html_extract.main_text(f"<article><p>{PROSE}there.<div/>more of the same<p/>and so on</article>") == f"{PROSE}there.\n\nmore of the same\n\nand so on"
    found = html_extract.blocks("<p><a href=http://x.y/>linked</a> <img src=a/> <b class=c />rest <a href = z/>too</a></p>")
    assert [(b.text, b.linked) for b in found] == [("linked rest too", 9)]


def test_first_pass_adds_its_evidence():
    r = random.Random(8)
    for _ in range(200):
        words = [r.choice(["the", "of", "und", "quartz", "Xylo"]) for _ in range(r.randint(1, 80))]
        text = " ".join(words)
        b = html_extract.Block(r.choice([0, 1]), r.choice([0, 0, 4]), False, text=text, linked=r.randint(0, len(text)))
        marked = r.random() < 0.5
        html_extract.first_pass(b, marked)
        stops = sum(w.lower() in ("the", "of", "und") for w in words) / len(words)
        want = min(stops / 0.25, 1) + min(len(text) / 200, 1) - 3 * b.linked / len(text) + (-4 if b.area else 1.25 if b.root else -1.5 if marked else 0)
        assert abs(b.evidence - want) < 1e-9 and b.label == ("good" if want >= 1.6 else "bad" if want <= 0 else "ambiguous")


def test_closing_over_a_link_ends_it():
    assert html_extract.main_text("<article><p><a href=x>foo</p><p>the man of the house</p></article>") == "the man of the house"


def test_broken_pages_take_time_in_proportion():
    import time

    began = time.time()
    for bad in ("<a " * 80_000, "<b>" * 80_000 + "</i>" * 80_000, "<b>" * 8000 + "<div></div>" * 50_000, "<!" * 80_000, "<div>" * 50_000, "<a href='" * 50_000, "<p>x" * 50_000):
        html_extract.main_text(bad)
    assert time.time() - began < 60


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>x"), (2, None, None)], "page_id long, url string, html string").selectExpr("*", "'t' as text")
    assert {(r.page_id, r.text) for r in html_extract.extract(df).collect()} == {(1, "x"), (2, "")}
    assert html_extract.extract(df.where("false")).count() == 0 and html_extract.extract(df.unionByName(df)).count() == 4


def test_language_mixture(spark):
    r = random.Random(4)
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    train = [(say(LATIN, 40), "la") for _ in range(40)] + [(say(OTHER, 40), "de") for _ in range(40)] + [(None, "la"), ("x", None)]
    model = langid.train_languages(spark.createDataFrame(train, "text string, lang string"))
    docs = [(1, say(LATIN, 50)), (2, say(OTHER, 50)), (3, say(LATIN, 60) + " " + say(OTHER, 60)), (4, None), (5, "12 !"), (6, ""), (7, say(OTHER, 200_000))]
    df = spark.createDataFrame([*docs, (8, "a")], "doc_id long, text string").selectExpr("*", "1 as languages").coalesce(1)
    got = {x.doc_id: {s.lang: s.share for s in x.languages} for x in langid.identify(df, model).collect()}
    assert set(got[1]) == {"la"} and set(got[2]) == {"de"} == set(got[7]) and set(got[3]) == {"la", "de"} and abs(got[3]["la"] - 0.5) < 0.15
    assert got[4] == got[5] == got[6] == {} and len(got[8]) == 1
    assert len(langid.trigrams(["\U00030010\U00031234"])[0]) == 2  # letters beyond U+30000
    assert len(langid.trigrams(["x"])[0]) == 1 and len(langid.trigrams(["", "1", "\ud800"])[0]) == 0
    none = langid.train_languages(spark.createDataFrame([], "text string, lang string"))
    assert langid.identify(df, none).where("size(languages) > 0").count() == 0


def test_any_number_of_languages(spark):
    r = random.Random(9)
    letters = [[chr(0x4E00 + 30 * k + j) for j in range(6)] for k in range(90)]
    say = lambda k, n: " ".join("".join(r.choices(letters[k], k=4)) for _ in range(n))
    model = langid.train_languages(spark.createDataFrame([(say(k, 60), f"l{k:02d}") for k in range(90)], "text string, lang string"))
    docs = [(k, say(k, 30)) for k in range(90)] + [(100, " ".join(say(k, 60) for k in range(7)))]
    got = {x.doc_id: {s.lang for s in x.languages} for x in langid.identify(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert all(got[k] == {f"l{k:02d}"} for k in range(90)) and got[100] == {f"l{k:02d}" for k in range(7)}


def test_texts_are_sliced_between_words(monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 10)
    texts = ["abcdefgh ijklmnop", None, "x" * 25 + " y", "short"]
    parts = [(i, p) for ids, run in langid.sliced(texts) for i, p in zip(ids, run, strict=True)]
    assert ["".join(p for i, p in parts if i == k) for k in range(4)] == [t or "" for t in texts]
    assert all(not (p and p[-1].isalpha() and q[0].isalpha()) for (i, p), (j, q) in zip(parts, parts[1:], strict=False) if i == j)


def test_toxicity_learns_from_weak_votes(spark):
    r = random.Random(6)
    bad = ["scumbag", "dimwit", "trashy", "moronic", "loserly", "nitwit"]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(LATIN + OTHER) for _ in range(60)]
        y = int(i % 8 == 0)
        if y:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    labels += [(None, 1), (3, None)]
    d, y = spark.createDataFrame([*docs, (None, None), (900, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_toxicity(d, y.where("doc_id % 5 <> 0 or doc_id is null"))
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(d, model).collect()}
    held = [(got[i], y) for i, y in labels[:600] if i % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.97
    assert got[900] < 0.5 and got[None] < 0.5
    nothing = toxicity.train_toxicity(d, y.where("false"))
    assert all(0 <= x.score <= 0.5 for x in toxicity.score_toxicity(d, nothing).collect())


def test_toxic_terms_outside_the_sample_are_mined(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    picked = [x.id for x in spark.range(1200).orderBy(F.xxhash64("id"), "id").limit(200).collect()]
    late = [i for i in range(1200) if i not in picked][:60]  # labelled, but never in the sample
    docs, labels = [], []
    for i in range(1200):
        w = [r.choice(LATIN + OTHER) for _ in range(40)]
        y = int(i % 8 == 0 or i in late)
        for _ in range(4 * y):
            w[r.randrange(40)] = "zorgle" if i in late else r.choice(["scumbag", "dimwit", "trashy", "moronic"])
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    new = [(5000, " ".join(["zorgle", *LATIN, "zorgle", *OTHER, "zorgle"])), (5001, " ".join(LATIN + OTHER))]
    d, y = spark.createDataFrame(docs + new, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_toxicity(d, y, sample=200)
    assert "zorgle" in model.lexicon.words
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(d, model).collect()}
    assert got[5000] >= 0.5 > got[5001] and all(got[i] >= 0.5 for i in late)


def test_toxicity_sample_bounds_what_the_driver_gets(spark, monkeypatch):
    rows = [(1, f"text number {i} " + "scumbag " * (i % 2)) for i in range(600)]
    d, y = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as found"), spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int")
    got = []
    fit = toxicity.fit_classifier
    monkeypatch.setattr(toxicity, "fit_classifier", lambda r, *a, **k: got.append(len(r)) or fit(r, *a, **k))
    toxicity.train_toxicity(d, y, sample=20)
    assert got[0] <= 20
    empty = toxicity.train_toxicity(d.where("false"), y)
    assert toxicity.score_toxicity(d.where("false"), empty).count() == 0 and toxicity.score_toxicity(d, empty).count() == 600


def test_label_model_reads_accuracies():
    r = np.random.default_rng(1)
    y = r.random(200_000) < 0.1
    hit, miss = np.full(toxicity.VOTERS, 0.0), np.full(toxicity.VOTERS, 0.0)
    hit[:6], miss[:6] = [0.9, 0.7, 0.5, 0.6, 0.8, 0.4], [0.02, 0.05, 0.01, 0.1, 0.03, 0.02]
    v = (r.random((len(y), toxicity.VOTERS)) < np.where(y[:, None], hit, miss)).astype(int)
    m = toxicity.fit_label_model(len(y), v.T @ v, 0.1)
    p = m.posterior(v)
    assert ((p > 0.5) == y).mean() > 0.98
    assert np.allclose(m.fire[:6], np.log(hit[:6] / miss[:6]), atol=0.35) and (m.share[6:] == 0).all()


def test_the_sample_is_exact_and_the_same_however_rows_are_dealt(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i % 40, f"t{i % 40}", i % 2) for i in range(200)], "doc_id long, text string, toxic int")
    by = F.xxhash64("doc_id", "text")
    got = [sorted((r.doc_id, r.h) for r in toxicity.sampled(rows.repartition(n), by, 200, 33).collect()) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 33
    assert got[0] == sorted(sorted(((r.doc_id, r.h) for r in rows.withColumn("h", by).collect()), key=lambda r: r[1])[:33])
    assert toxicity.sampled(rows, by, 200, 500).count() == 200
