import hashlib
import math
import random
import re
import sys

import pytest

from lodestone.llm import pii

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    sys.set_int_max_str_digits(0)
    out = []
    for k, (kind, p) in enumerate(RX.items()):
        for m in re.finditer(p, text or ""):
            v, d = m[0], re.sub("[^0-9]", "", m[0])
            if (kind != "ip" or all(int(x) <= 255 for x in v.split("."))) and (kind != "card" or 12 <= len(d) <= 19 and luhn(d)) and (kind != "phone" or 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    out = [None, "", "a@b.c_d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.0004", "é😀 x@y.zz 4111 1111-1111 1111 +1 (017) 555-7713", "0" * 30, "a" * 50_000 + " b@c.d", ".".join(["a"] * 9000) + "@x.y", "x@" + ".".join(["a"] * 9000), "1" * 20_000 + ".1.1.1", "1." * 5000, "+1 " + "( " * 3000, "1 " * 9000, "1.2.3.4 é " * 12_345]
    out += ["".join(r.choice("ab@.+- 1234567890()é😀") for _ in range(r.randint(0, 60))) for _ in range(800)]
    return out + ["".join(r.choice("1234 -.+@a") for _ in range(r.randint(0, 60))) for _ in range(400)]


def test_base_spans_equal_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(s.start, s.order, s.end, s.kind) for s in r.spans] for r in pii.with_base_spans(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_disclosing_terms_are_found_and_generalised(spark):
    r = random.Random(9)
    vocab = [f"{a}{b}or" for a in "bcdfgklm" for b in "aeiou"]
    said = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = [(i, f"{said(20)} {r.choice(vocab)} kingmaker {r.choice(vocab)} boss@corp.com {said(10)}", 0) for i in range(12)]
    rows += [(100 + i, said(30), 0) for i in range(200)] + [(900, None, 0), (901, "", 0), (None, "me@you.org", 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    for i in range(12):
        text = rows[i][1]
        at = text.index("kingmaker")
        assert ("term", at, at + 9) in {(s.kind, s.start, s.end) for s in got[i].spans}
        assert "kingmaker" not in got[i].clean and "[TERM]" in got[i].clean and "[EMAIL]" in got[i].clean
        assert {s.value for s in got[i].spans if s.kind == "term"} == {"kingmaker"}
    assert all(not got[100 + i].spans and got[100 + i].clean == rows[12 + i][1] for i in range(200))
    assert got[900].clean == got[901].clean == "" and got[None].clean == "[EMAIL]"


def test_terms_with_fixed_neighbours_are_masked_wherever_they_stand(spark):
    far, run = "zeta " * 40, "".join(chr(0x4E00 + i) for i in range(200))
    rows = [(i, f"start{chr(97 + i)}q Alice Johnson a.j@corp.com likes blue tea {far} johnson again") for i in range(4)]
    rows += [(10 + i, f"{run}1.2.3.4 {'x' * i}") for i in range(4)]
    rows += [(20 + i, "Copied kings@corp.com") for i in range(5)]  # one text, however often
    rows += [(100 + i, f"zeta likes blue tea {i}") for i in range(60)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        assert {s.value for s in got[i].spans if s.kind == "term"} == {"alice", "johnson"}
        assert got[i].clean == f"start{chr(97 + i)}q [TERM] [TERM] [EMAIL] likes blue tea {far} [TERM] again"
        assert got[10 + i].clean.startswith("[TERM][IP] ")
    assert {got[20 + i].clean for i in range(5)} == {"Copied [EMAIL]"}
    assert got[100].clean == "zeta likes blue tea 0"


def disclosed(rows, reach=3, support=3, threshold=0.8):
    """Brute force of the disclosing pairs: {(entity, term)}."""
    term = re.compile(r"[^\W\d_]{3,}")
    near, held, freq = {}, {}, {}
    for k, text in enumerate(rows):
        spans = brute(text)
        inside = lambda m: any(m.start() < e and m.end() > a for a, _, e, _ in spans)
        free = [m for m in term.finditer(text) if not inside(m)]
        for w in {m[0].lower() for m in term.finditer(text)}:
            freq[w] = freq.get(w, 0) + 1
        for a, _, e, kind in spans:
            before = sum(m.start() < a for m in free)
            for entity in (kind, f"{kind}:{text[a:e]}"):
                held.setdefault(entity, set()).add(k)
                for m in free[max(before - reach, 0) : before + reach]:
                    near.setdefault((entity, m[0].lower()), set()).add(k)
    n, out = len(rows), set()
    for (c, t), docs in near.items():
        p = len(held[c]) / n
        if len({rows[k] for k in docs}) >= support and p < 1 and math.log(len(docs) / (freq[t] + 1) / p) / -math.log(p) >= threshold:
            out.add((c, t))
    return out


def test_disclosure_equals_brute_force(spark):
    r = random.Random(21)
    words = [f"w{a}{b}rd" for a in "abcdefgh" for b in "klmnop"]
    texts = []
    for i in range(400):
        w = [r.choice(words) for _ in range(r.randint(5, 25))]
        if i % 9 == 0:
            at = r.randrange(len(w))
            w[at:at] = r.choice([["mail", "me", f"u{i}@x{i}.org"], ["server", "10.0.0.7", "down"], ["reach", f"+1 555 000 {i:04d}"], ["Bob", "boss@corp.com"]])
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = pii.with_base_spans(docs).where("size(spans) > 0").withColumnRenamed("doc_id", "_row")
    bad = pii.disclosing_terms(docs, pii.contexts(found, 3), threshold=0.8, support=3).collect()
    want = disclosed(texts)
    assert {(x.entity, x.term) for x in bad} == want and {("email", "mail"), ("ip", "server"), ("ip:10.0.0.7", "down"), ("phone", "reach"), ("email:boss@corp.com", "bob")} <= want
    done = {x.doc_id: x for x in pii.sanitise(docs).collect()}
    for i, t in enumerate(texts):
        held = {e for a, _, b, kind in brute(t) for e in (kind, f"{kind}:{t[a:b]}")}
        free = {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(m.start() < b and m.end() > a for a, _, b, _ in brute(t))}
        assert {s.value for s in done[i].spans if s.kind == "term"} == {w for e, w in want if e in held and w in free}


def test_secrets_and_their_cues(spark):
    r = random.Random(2)
    key = lambda: "".join(r.choice("0123456789") + r.choice("abcdef") for _ in range(20))
    rows = [(i, f'the config says apikey = "{key()}" in line {"abcdefghij"[i]}') for i in range(10)] + [(100 + i, f"the config says nothing in line {i} of a-very-long-hyphenated-headline-2024 12345678901234567890") for i in range(90)]
    got = {x.doc_id: x for x in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(10):
        assert [s.kind for s in got[i].spans] == ["term", "secret"] and got[i].clean.startswith('the config says [TERM] = "[SECRET]" in line')
    assert not any(got[100 + i].spans for i in range(90))


def test_long_texts_with_many_spans(spark):
    text = " ".join(f"é{i % 10}@b.cd" for i in range(40_000))
    x = pii.sanitise(spark.createDataFrame([(1, text), (2, "word " * 200_000)], "doc_id long, text string")).where("doc_id = 1").first()
    assert len(x.spans) == 40_000 and x.clean == " ".join(["é[EMAIL]"] * 40_000)


def test_digest(spark):
    text = "x@y.zz 1.2.3.4"
    r = pii.digest(pii.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    said = "email:0:6,ip:7:14"
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans, r.base_sha256) == (1, 1, 0, 0, said, hashlib.sha256(said.encode()).hexdigest())


def test_empty_table(spark):
    assert pii.sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlapping_spans_are_cut_once(spark):
    r = pii.sanitise(spark.createDataFrame([(1, "+1 2.3.4.5 67890 end")], "doc_id long, text string")).first()
    assert len(r.spans) == 2 and r.clean == "[PHONE] end"
