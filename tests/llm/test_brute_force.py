"""Registered queries held against plain second versions at production parameters."""

import datetime
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabdelta.llm import language_id, pii, queries, suffix_dedup


def removed_windows(texts, t):
    """Per text: covered bytes, runs and the digest of the rest, from all windows in one suffix-array-like sort."""
    data = [(x or "").encode() for x in texts]
    first, twice = {}, set()
    for b in data:
        for s in range(len(b) - t + 1):
            h = hash(b[s : s + t])
            if h in first:
                twice.add(h)
            else:
                first[h] = True
    groups = defaultdict(list)
    for k, b in enumerate(data):
        for s in range(len(b) - t + 1):
            if (h := hash(b[s : s + t])) in twice:
                groups[h].append((k, s))
    cover = [np.zeros(len(b) + 1, np.int64) for b in data]
    for own in groups.values():
        count = Counter(data[k][s : s + t] for k, s in own)
        for k, s in own:
            if count[data[k][s : s + t]] > 1:
                cover[k][s] += 1
                cover[k][min(s + t, len(data[k]))] -= 1
    out = []
    for b, c in zip(data, cover):
        on = np.cumsum(c)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~on].tobytes()
        runs = int((np.diff(np.concatenate([[0], on.astype(np.int8)])) == 1).sum())
        out.append((len(b), int(on.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_op7_equals_brute_force_at_400_bytes(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], removed_windows([d.text for d in docs], suffix_dedup.THRESHOLD)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, sf).collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 50


class PlainFeistel:
    """The permutation once more, from its definition: rounds over two halves of bits, walked until the value is in range."""

    def __init__(self, key):
        self.key = hashlib.sha256(key).digest()

    def __call__(self, x, n, label):
        if n < 2:
            return x
        half = 1
        while 1 << (2 * half) < n:
            half += 1
        size = -(-half // 8)
        while True:
            left, right = divmod(x, 1 << half)
            for k in range(10):
                data = f"{k}|{label}|{n}|".encode() + right.to_bytes(size, "big")
                f = int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=size + 8).digest(), "big") % (1 << half)
                left, right = right, left ^ f
            x = left * (1 << half) + right
            if x < n:
                return x


def plain_card(f, v):
    digits = [int(c) for c in v if c.isdigit()]
    check = lambda ds: (10 - sum(d if k % 2 else (2 * d if d < 5 else 2 * d - 9) for k, d in enumerate(reversed(ds))) % 10) % 10
    if check(digits[:-1]) != digits[-1] or not any(digits):
        return None
    n = len(digits) - 1
    body = [int(c) for c in f"{f(int(''.join(map(str, digits[:-1]))), 10**n, 'card'):0{n}d}"]
    out = iter([*body, check(body)])
    return "".join(str(next(out)) if c.isdigit() else c for c in v)


def plain_ip(f, v):
    parts = v.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = f(sum(int(p) << s for p, s in zip(parts, (24, 16, 8, 0))), 2**32, "ip")
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


DAYS = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in range((datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days)]
LATE = [d for d in DAYS if d.day >= 13]


def plain_date(f, v):
    days, late = DAYS, LATE
    a, b, c = re.split(r"\D", v)
    gap = v[len(a)]
    orders = [(a, b, c)] if gap == "-" else [(c, b, a)] + ([(c, a, b)] if gap == "/" else [])
    for turn, (y, m, d) in enumerate(orders):
        try:
            date = datetime.date(int(y), int(m), int(d))
        except ValueError:
            continue
        if turn == 0:
            if date not in days:
                return None
            new = days[f(days.index(date), len(days), "date")]
            return f"{new:%Y-%m-%d}" if gap == "-" else f"{new:%d{gap}%m{gap}%Y}"
        return f"{late[f(late.index(date), len(late), 'date|month first')]:%m/%d/%Y}" if date in late else None
    return None


def plain_phone(f, v):
    head = m[0] if (m := re.match(r"\+\d{1,3}", v)) else ""
    rest = v[len(head) :]
    digits = "".join(c for c in rest if c.isdigit())
    if not 6 <= len(digits) <= 14:
        return None
    out = iter(f"{f(int(digits), 10 ** len(digits), 'phone|' + head):0{len(digits)}d}")
    return head + "".join(next(out) if c.isdigit() else c for c in rest)


def plain_classes(f, part, label, at=0):
    """One number in mixed radix over the characters' classes, most significant first."""
    classes = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
    own = [next((c for c in classes if x in c), "") for x in part]
    x, n = 0, 1
    for ch, c in zip(part, own):
        if c:
            x, n = x * len(c) + c.index(ch), n * len(c)
    x = f(x, n, f"{label}|{at}|" + "".join(str(classes.index(c)) if c else "-" for c in own))
    out = list(part)
    for k in range(len(part) - 1, -1, -1):
        if own[k]:
            x, digit = divmod(x, len(own[k]))
            out[k] = own[k][digit]
    return "".join(out)


def plain_email(f, v):
    local, domain = v.rsplit("@", 1)
    return f"{plain_classes(f, local, 'email|' + domain.lower())}@{domain}"


def test_op9_equals_a_second_version(spark):
    """Whole rewritten texts: values found by the fixed patterns, one kind after the other at each place, mapped by the plain versions."""
    sf, f = "/root/testdata/sf0.01", PlainFeistel(pii.DEMO_KEY)
    plain = {"card": plain_card, "ip": plain_ip, "date": plain_date, "phone": plain_phone, "email": plain_email}
    kinds = [(k, re.compile(v)) for k, v in pii.PATTERNS.items()]
    maps = pii.Pseudonyms(pii.DEMO_KEY)

    def rewrite(text):
        out, at, n = [], 0, Counter()
        while True:
            hits = [(m.start(), order, kind, m) for order, (kind, p) in enumerate(kinds) if (m := p.search(text, at))]
            if not hits:
                return "".join(out) + text[at:], n
            start, _, kind, m = min(hits, key=lambda h: h[:2])
            # ssn, iban and secret have no plain version here; test_values_keep_their_format covers their inverses
            new = plain[kind](f, m[0]) if kind in plain else maps.swap(kind, m[0])
            n[kind] += new is not None
            out += [text[at:start], m[0] if new is None else new]
            at = m.end()

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op9_pii(spark, sf).collect()}
    seen = Counter()
    for d in docs:
        text, n = (None, {}) if d.text is None else rewrite(d.text)
        assert got[d.doc_id].text == text and got[d.doc_id].n_pseudonyms == sum(n.values())
        seen.update(n)
    assert len([k for k in plain if seen[k]]) >= 3, seen
    rnd = random.Random(3)
    for _ in range(100):
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rnd.randrange(73049))
        for v in (f"{day:%Y-%m-%d}", f"{day:%d/%m/%Y}", f"{day:%m/%d/%Y}", f"{day:%d.%m.%Y}"):
            assert maps.swap("date", v) == plain_date(f, v)
        ip = ".".join(str(rnd.randrange(256)) for _ in range(4))
        assert maps.swap("ip", ip) == plain_ip(f, ip)


def plain_model(rows):
    """Log likelihoods by a dictionary of trigram slots, from whole texts."""
    def slots(text):
        words = re.sub("[ \t-\r]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).strip(" ")
        raw = f" {words} ".encode() if words else b""
        return [((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 2654435761 % 2**32) >> (32 - language_id.TABLE_BITS) for k in range(len(raw) - 2)]

    counts = defaultdict(Counter)
    for lang, text in rows:
        counts[lang].update(slots(text))
    langs, size = sorted(counts), 1 << language_id.TABLE_BITS
    total = {x: sum(counts[x].values()) + 0.1 * size for x in langs}

    def scores(text):
        own = slots(text)
        ll = {x: sum(math.log((counts[x][s] + 0.1) / total[x]) for s in own) for x in langs}
        mean = sum(ll.values()) / len(langs)
        return {x: (v - mean) * language_id.TEXT_EVIDENCE / max(len(own), language_id.TEXT_EVIDENCE) for x, v in ll.items()}, len(own)

    return langs, scores


def soft(ll):
    top = max(ll.values())
    e = {x: math.exp(v - top) for x, v in ll.items()}
    return {x: v / sum(e.values()) for x, v in e.items()}


def fuse(langs, rows):
    """rows: (id, text scores, n, url, host, declared). The posterior of each from sums over all of them."""
    strength, code = language_id.HOST_STRENGTH, language_id.CODE_STRENGTH
    parts = {}
    for i, _, _, url, host, _ in rows:
        m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", url or "")
        name = m[1].lower() if m else None
        path = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", url or "")
        labels = name.split(".") if name else []
        suffix = "/".join(([labels[-1]] if labels else []) + ([path[1].lower()] if path else []))
        parts[i] = (name or host, ".".join(labels[-2:]) or None, labels[-1] if labels else None, suffix)
    sums = [defaultdict(lambda: dict.fromkeys(langs, 0.0)) for _ in range(6)]
    for i, ll, n, _, _, said in rows:
        if n:
            host, domain, top, suffix = parts[i]
            keys = ("all", top, (domain, top), (host, domain), said, suffix)
            for k, key in enumerate(keys):
                for x, p in soft(ll).items():
                    sums[k][key][x] += p
    mass = {x: 1 + sums[0]["all"][x] for x in langs}
    base = {x: m / sum(mass.values()) for x, m in mass.items()}
    shrink = lambda own, up: {x: (own[x] + strength * up[x]) / (sum(own.values()) + strength) for x in langs}
    out = {}
    for i, ll, n, _, _, said in rows:
        host, domain, top, suffix = parts[i]
        prior = base
        if host is not None and (host, domain) in sums[3]:
            if domain is not None and (domain, top) in sums[2]:
                prior = shrink(sums[2][domain, top], shrink(sums[1][top], base) if top is not None and top in sums[1] else base)
            prior = shrink(sums[3][host, domain], prior)
        total = {x: ll[x] + math.log(prior[x]) for x in langs}
        for table, key in ((4, said), (5, suffix)):
            if key is not None and key in sums[table]:
                own = sums[table][key]
                for x in langs:
                    total[x] += math.log((own[x] + code * base[x]) / (sum(own.values()) + code) / base[x])
        p = soft(total)
        best = min(langs, key=lambda x: (-total[x], x))
        out[i] = (best, p[best], n)
    return out


def test_op10_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    langs, scores = plain_model([(d.lang, d.text or "") for d in docs if d.lang])
    rows = [(("d", d.doc_id), *scores(d.text or ""), None, d.source, None) for d in docs]
    want = fuse(langs, rows)
    own = []
    for p in pages:
        m = re.search(r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2})", p.html or "")
        said = m[1].lower() if m and m[1].lower() in langs else None
        text = language_id._TAGS.sub(b" ", (p.html or "").encode()).decode()
        own.append((("p", p.page_id), *scores(text), p.url, None, said))
    want |= fuse(langs, own)
    got = queries.op10_language_id(spark, sf).collect()
    assert len(got) == len(docs) + len(pages)
    for r in got:
        language, posterior, n = want[("d", r.doc_id) if r.doc_id is not None else ("p", r.page_id)]
        assert (r.language, r.n_grams) == (language, n) and r.posterior == pytest.approx(posterior, abs=2e-3)
