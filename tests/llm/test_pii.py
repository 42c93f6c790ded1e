"""PII: pattern spans against a plain reading of their definition, and deobfuscation mapped back to the source."""

import hashlib
import re

import pytest

from rosterlake.llm import pii
from rosterlake.llm.book import load

OP = load()[0]["op6_pii_deobfuscation"]


def luhn(digits):
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1]))
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def check(row, text):
    base = brute(text or "")
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row.spans.split(",") if s)]
    assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_given_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in OP(spark, sf_dir).collect():
        check(r, texts[r.doc_id])


EDGES = [
    "a@b.c", "a@b", "@b.c", "a@b.c@d.e", "x@@b.c y@b..c", "%+-._@-.-", "é@b.co a.b+c%d@x-y.z.w.", "a@b.c.d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8",
    "0001.2.3.4", "999.1.1.1.1", "4465758382889437", "4465 7583 8288 9437", "4465-7583-8288-9437 1", "4465  7583", "4465758382889438", "12345678901234567890",
    "+1 (555) 555-0100", "+1", "+12", "+1 2", "+123456789", "+1234567890", "+1234567890123456", "+49.(0)30-1234567x", "++1 5555555555", "+1 555 555 0100 4465758382889437",
    "", None, " ", "\n" * 5, "٣٣٣.٣.٣.٣", "1." * 20_000, "a" * 100_000 + "@b.c", "9" * 50_000, "+1" + " 2" * 30_000,
]


def test_edge_rows(spark, stored):
    docs = list(enumerate(EDGES)) + [(None, EDGES[0]), (0, EDGES[0])]
    got = OP(spark, stored(docs)).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        check(r, texts[r.doc_id])


@pytest.mark.parametrize("text, kind, part", [
    ("write to jane.roe [at] example [dot] com today", "email", "jane.roe [at] example [dot] com"),
    ("write to jane (AT) example (DOT) co (dot) uk", "email", "jane (AT) example (DOT) co (dot) uk"),
    ("mail bob at example dot org please", "email", "bob at example dot org"),
    ("juan arroba ejemplo punto es", "email", "juan arroba ejemplo punto es"),
    ("bob@example dot org!", "email", "bob@example dot org"),
    ("mail jane＠example．com now", "email", "jane＠example．com"),
    ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
    ("ja​ne@example.com", "email", "ja​ne@example.com"),
    ("call plus one five five five five five five zero one zero zero now", "phone", "plus one five five five five five five zero one zero zero"),
    ("call ＋１ (555) 555-0100", "phone", "＋１ (555) 555-0100"),
    ("eins zwei sieben punkt null punkt null punkt eins", "ip", "eins zwei sieben punkt null punkt null punkt eins"),
    ("card four four six five seven five eight three eight two eight eight nine four three seven.", "card",
     "four four six five seven five eight three eight two eight eight nine four three seven"),
    ("４４６５７５８３８２８８９４３７", "card", "４４６５７５８３８２８８９４３７"),
    ("write john.doe at example.com today", "email", "john.doe at example.com"),
    ("write john at example [dot] com", "email", "john at example [dot] com"),
    ("write john at mail.example dot com", "email", "john at mail.example dot com"),
    ("john [at] example dot app", "email", "john [at] example dot app"),
    ("john (at) example dot online!", "email", "john (at) example dot online"),
    ("call five five five 0100 now", "phone", "five five five 0100"),
    ("plus one 555 five five five 0100 now", "phone", "plus one 555 five five five 0100"),
    ("mail 𝐣𝐨𝐡𝐧@example.com", "email", "𝐣𝐨𝐡𝐧@example.com"),
    ("see foo&#64;example.com there", "email", "foo&#64;example.com"),
    ("see foo&commat;example&#x2e;com there", "email", "foo&commat;example&#x2e;com"),
    ("mail name @ example . com or", "email", "name @ example . com"),
    ("ʝohn＠example．com", "email", "ʝohn＠example．com"),
    ("so öjohn＠example．com", "email", "öjohn＠example．com"),
])
def test_hidden_identifiers(text, kind, part):
    _, spans = pii.all_spans(text)
    at = text.index(part)
    assert any(s == (kind, at, at + len(part)) for s in spans) or \
        any(k == kind and a <= at + 1 and b >= at + len(part) - 1 and b - a <= len(part) + 2 for k, a, b in spans), spans


@pytest.mark.parametrize("text", [
    "he was at home dot the end", "look at this point of view", "one two three", "seven of nine", "un deux trois", "the [at] sign alone",
    "we met at noon. com is an ending", "meet @ noon . then go", "five five five 0100 apples", "AT&T and R&D &amp; &#10; more", "10 m² at ½ price.",
    "look at example.", "see you at the.end of it", "Москва и Киев", "naïve café – déjà vu", "at dot at dot", "one, two and three at 5 o'clock", "a [dot] b",
])
def test_clean_texts_stay_clean(text):
    assert pii.all_spans(text) == ([], [])


def test_masking(docs_of):
    docs = docs_of([(1, "mail a@b.c and 1.2.3.4.", "en", "s", 99), (2, None), (3, "clean", None, None, 5)])
    got = {r.doc_id: r for r in pii.without_personal_data(docs).collect()}
    assert got[1].text == "mail <EMAIL> and <IP>." and got[1].n_chars == len(got[1].text) and got[1].lang == "en"
    assert got[2].text is None and got[2].n_chars is None and got[3].n_chars == 5
    assert pii.masked("+1 555 555 0100 44", [("phone", 0, 18), ("card", 3, 18)]) == "<PHONE>"
    assert pii.without_personal_data(docs_of([])).collect() == [] and pii.search(docs_of([])).collect() == []


@pytest.mark.parametrize("text", [
    "7" * 1_000_000, "a@b.co " * 30_000 + "x [at] y", " " * 1_000_000 + "[x] at b", "%" * 300_000 + " at ", "+1" * 200_000,
    "one " * 100_000, "x at y dot " * 40_000, "a. " * 200_000 + "@", "&#" * 300_000,
], ids=["digits", "addresses", "blanks", "signs", "plus", "spelled", "spoken", "dots", "references"])
def test_time_is_linear_in_a_text(text):
    import time
    t = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - t < 8
