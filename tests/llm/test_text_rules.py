import hashlib
import random
import re
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st

from tabdelta.llm import language_id, license_scan, pii, quality_rules as q


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            marked |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(marked)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t\x0b\x0c\r\x1c\x85\xa0é#$|")), max_size=80))
def test_measurements(text):
    got = q.measure(text.encode())
    assert (got[0], got[1], got[2], got[4], got[5]) == plain(text)


def test_ledger_policies_and_ablations(spark):
    good = " ".join(f"word{k}" for k in range(60))
    texts = [good, None, "", "a b c " * 40, good.upper(), good + " #" * 30, "\n".join(["same line here now"] * 3 + [good])]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = q.ledger(df).cache()
    fails = {r.doc_id: {n for k, n in enumerate(q.RULES) if r.fail_bits >> k & 1} for r in rows.collect()}
    assert fails[0] == set() and "few_words" in fails[1] & fails[2] and "repeated_windows" in fails[3] and fails[4] == {"shouting"} and "symbols" in fails[5]
    ab = {r.rule: r for r in q.ablations(rows, "full-1").collect()}
    for name in q.POLICIES["full-1"]:
        assert ab[name].n_failed == sum(name in f for f in fails.values())
        assert ab[name].n_failed_only == sum(f == {name} for f in fails.values())
        assert ab[name].n_kept_without == sum(not f - {name} for f in fails.values())
    kept = q.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, f in fails.items() if not f}
    assert q.ledger(df.limit(0)).count() == 0


def test_license_scan(spark):
    mit = "Released under the MIT License."
    rows = [(1, f"text\n{mit}\nmore"), (2, "RELEASED under  the MIT licence"), (3, f"we {mit} inline"), (4, None), (5, "Copyright 2020 A\n\n" + mit), (1, "Licensed under CC BY-NC 4.0."), (None, mit)]
    got = {r.doc_id: (r.license_ids, r.whole_text) for r in license_scan.license_scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license_ids string")).collect()}
    assert got == {1: (["CC-BY-NC-4.0", "MIT"], True), 2: (["MIT"], True), 3: ([], False), 4: ([], False), 5: (["MIT"], True), None: (["MIT"], True)}
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_paragraphs_after_any_blank_line(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies."
    rows = [(k, f"before{gap}{isc.replace(chr(10), end)}{gap}after") for k, (gap, end) in enumerate([("\n\n", "\n"), ("\r\n\r\n", "\r\n"), ("\n \n", "\n"), ("\n\t \r\n", "\n"), ("\n", "\n")])]
    got = {r.doc_id: (r.license_ids, r.n_units, r.whole_text) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (["ISC"], 1, False) for k in range(4)} | {4: ([], 0, False)}


def test_needles_are_in_every_known_text_however_it_is_spelled(spark):
    words = license_scan.needles()
    assert 0 < len(words) <= 12
    swap = [(form, pattern) for pattern, form in license_scan.SPELLINGS if form.strip()]
    for _, text in license_scan.KNOWN:
        variants = [text, text.upper(), *(text.lower().replace(form.strip(" "), pattern) for form, pattern in swap)]
        for v in variants:
            if license_scan.plain_canonical(v) == license_scan.plain_canonical(text):
                assert any(w in v.lower() for w in words)
    assert license_scan.needles((("X", "a b c d"),)) == ()
    want = {(r.license_id, r.digest) for r in license_scan.known_table(spark).collect()}
    assert want == {(k, hashlib.sha256(c.encode()).hexdigest()) for k, t in license_scan.KNOWN if (c := license_scan.plain_canonical(t))}


def test_license_table_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "Ours: do as you like."), (2, "other")], "doc_id long, text string")
    known = spark.createDataFrame([("Ours", "ours do as you like")], "license_id string, c string").selectExpr("sha2(c, 256) AS digest", "license_id")
    assert {r.doc_id: r.license_ids for r in license_scan.license_scan(docs, known=known).collect()} == {1: ["Ours"], 2: []}


def test_complete_licenses(spark):
    read = lambda name: (Path(license_scan.__file__).parent / "licenses" / f"{name}.txt").read_text()
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "MIT", "0BSD", "Unlicense"]
    three = read("BSD-3-Clause")
    two = three[: three.index("3. Neither")] + three[three.index("THIS SOFTWARE") :]
    texts = {n: read(n) for n in names} | {"BSD-3-Clause": "Copyright (c) 2020 A. All rights reserved.\n\n" + three, "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright 2020 A\nAll rights reserved.\n\n" + two}
    rows = [*texts.items(), ("opening", three[: three.index("1.")]), ("title", "MIT License\n\nCopyright (c) 2020 A\n\n" + read("MIT")), ("cut", read("Apache-2.0").partition("   APPENDIX")[0]), ("crlf", read("GPL-3.0").replace("\n", "\r\n"))]
    got = {r.doc_id: (set(r.license_ids), r.whole_text) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    want = {n: ({n}, True) for n in names} | {f"BSD-{k}-Clause": ({"BSD", f"BSD-{k}-Clause"}, True) for k in (2, 3)}
    assert got == want | {"opening": ({"BSD"}, True), "title": ({"MIT"}, True), "cut": ({"Apache-2.0"}, True), "crlf": ({"GPL-3.0"}, True)}


KEY = b"a test key of some length"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300))
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(KEY)
    image = [f.permute(x, n, "t") for x in range(n)]
    assert sorted(image) == list(range(n)) and [f.permute(y, n, "t", True) for y in image] == list(range(n))


def card(rnd):
    body = "".join(rnd.choice("0123456789") for _ in range(15))
    return body + pii.luhn_digit(body)


def test_values_keep_their_format_and_come_back():
    rnd, maps = random.Random(6), pii.Pseudonyms(KEY)
    c = card(rnd)
    values = [("card", c), ("card", "-".join(c[i : i + 4] for i in (0, 4, 8, 12))), ("email", "the.72+x@mail3.example.com"), ("phone", "+1 (017) 555-7713"), ("ip", "169.122.221.182"), ("date", "2024-02-29"), ("date", "31.12.1999"), ("date", "12/25/1990"), ("date", "05/06/2001"), ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"), ("secret", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962'), ("secret", "password: abcDEF123456_-xyz99")]
    for kind, v in values:
        out = maps.swap(kind, v)
        assert out != v and len(out) == len(v) or kind == "ip"
        assert out != v and maps.swap(kind, out, True) == v and maps.swap(kind, v) == out
        assert kind == "ip" or re.sub(r"\d", "9", re.sub("[A-F]|[a-z]", "a", out)).count("9") >= 1
    for kind, v in (("card", c[:-1] + str((int(c[-1]) + 1) % 10)), ("ip", "300.1.1.1"), ("date", "2023-02-29"), ("ssn", "000-12-3456"), ("iban", "DE00370400440532013000")):
        assert maps.swap(kind, v) is None


def test_texts_stay_linked_and_clean_ones_alone(spark):
    c, bad = card(random.Random(8)), "4780385592391139"
    bad = bad if pii.luhn_digit(bad[:-1]) != bad[-1] else bad[:-1] + str((int(bad[-1]) + 1) % 10)
    rows = [(1, f"pay {c} now"), (2, f"### {c}$$$ from the.72@mail3.example.com and {bad}"), (3, None), (4, "version 1.2.3, 2 + 2 = 4, page 12"), (5, "")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_card string"), key=KEY).collect()}
    swapped = pii.Pseudonyms(KEY).swap("card", c)
    assert swapped in got[1].text and swapped in got[2].text and bad in got[2].text and "the.72@" not in got[2].text
    assert got[3].text is None and got[4].text == rows[3][1] and got[4].n_pseudonyms == 0 and got[2].n_card == 1
    assert pii.pseudonymise_text(got[2].text, KEY, back=True)[0] == rows[1][1]
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), key=KEY).count() == 0


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    model = language_id.train(docs.where("doc_id % 2 = 0"), rows=200)
    held = docs.where("doc_id % 2 = 1")
    got = {r.doc_id: r.language for r in language_id.identify(held.drop("lang"), model, host_col="source").collect()}
    rows = held.collect()
    assert sum(got[r.doc_id] == r.lang for r in rows) >= 0.97 * len(rows)


def test_rare_languages_are_known(spark):
    rows = [(k, "the words of a text", "en") for k in range(3000)] + [(k, "sanoja jotka ovat suomea", "fi") for k in range(3000, 3002)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=20)
    assert model.languages == ("en", "fi")


def test_language_evidence_without_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(docs, rows=200)
    by = {r.lang: r.text for r in docs.where("length(text) > 500").collect()}
    page = lambda lang, text: f'<html lang="{lang}"><p>{text}</p></html>'
    rows = [(k, f"http://{'a' if lang == 'de' else 'b'}.example.org/{lang}/{k}", page(lang, by[lang])) for k, lang in enumerate(["de", "en", "fr", "es"] * 10)]
    rows += [(100, "http://a.example.org/de/1", page("de", "")), (101, "http://a.example.org/x", ""), (102, None, None), (103, "not an address", "<html lang='xx'></html>")]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model, "html", url_col="url", markup=True).collect()}
    assert len(got) == len(rows) and got[100].language == "de" and got[101].language == "de" and got[100].text_language is None
    assert all(got[k].language == ["de", "en", "fr", "es"][k % 4] for k in range(40))
    assert got[102].language in model.languages and 0 < got[102].posterior <= 1
    assert language_id.identify(spark.createDataFrame([], "page_id long, url string, html string"), model, "html", url_col="url", markup=True).count() == 0
    with pytest.raises(ValueError):
        language_id.TextModel.fit({})


_DECIMALS = [chr(c) for c in range(0x110000) if chr(c).isdecimal()]
_SHAPES = ["000-00-0000", "0000-00-00", "00/00/0000", "00.00.0000", "+00 000 000 0000", "(000) 000-0000", "000-000-0000", "0.00.000.00", "000.0.0.0", "0000 0000 0000 0000", "0000000000000000", "DE00 0000 0000 0000 0000 00", "a0.b@ex0.org", "token=aaaa0000bbbb0000cc", "secret: 0000000000000000", "999-00-0000"]


@st.composite
def texts_of_any_digits(draw):
    """Values in the shapes that are swapped, their digits ASCII or of any script, single or mixed."""
    out = []
    for shape in draw(st.lists(st.sampled_from(_SHAPES), min_size=1, max_size=5)):
        pool = draw(st.sampled_from([list("0123456789"), _DECIMALS, list("٠١٢٣٤٥٦٧٨٩"), list("0123456789٣९")]))
        out.append("".join(draw(st.sampled_from(pool)) if c == "0" else c for c in shape))
        out.append(draw(st.sampled_from([" ", "\n", ", ", "٣", " x ", "", "."])))
    return "".join(out)


@settings(max_examples=400, deadline=None)
@given(texts_of_any_digits())
def test_pseudonyms_of_any_text_raise_nothing_and_leave_other_digits(text):
    new, counts = pii.pseudonymise_text(text, KEY)
    assert len(new) >= 1 and all(n > 0 for n in counts.values())
    other = lambda t: [c for c in t if c.isdecimal() and not c.isascii()]
    assert other(new) == other(text)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(_SHAPES).flatmap(lambda shape: st.tuples(*[st.sampled_from("0123456789") if c == "0" else st.just(c) for c in shape]).map("".join)))
def test_every_swap_comes_back(value):
    new, counts = pii.pseudonymise_text(f"at {value} end", KEY)
    back, again = pii.pseudonymise_text(new, KEY, back=True)
    assert back == f"at {value} end" and again == counts


def test_digits_of_other_scripts_do_not_fail_a_table(spark):
    rows = [(0, "٠٠٠-١٢-٣٤٥٦ 1"), (1, "٩٩٩-١٢-٣٤٥٦ 2"), (2, "call ٠٤٠-٥٥٥-١٢٣٤ or 040-555-1234"), (3, "१२३.४.५.६ and 1.2.3.4")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), key=KEY).collect()}
    assert got[0].text == rows[0][1] and got[1].text == rows[1][1]
    assert got[2].text.startswith("call ٠٤٠-٥٥٥-١٢٣٤ or ") and got[2].n_phone == 1 and got[3].text.startswith("१२३.४.५.६ and ") and got[3].n_ip == 1


def test_forms_that_the_inverse_relies_on_are_kept():
    class Tiny(pii.Feistel):
        """Values move on by one, so that every excluded value is hit."""

        def permute(self, x, n, label, back=False):
            return (x - 1 if back else x + 1) % n

    maps = pii.Pseudonyms(KEY)
    maps.feistel = Tiny(KEY)
    for value in ("token=" + "f" * 15 + "9", "token=" + "a" * 14 + "9z", "secret=" + "9" * 16):
        assert maps.swap("secret", maps.swap("secret", value), True) == value
    assert maps.swap("card", maps.swap("card", "9999999999999995"), True) == "9999999999999995"
