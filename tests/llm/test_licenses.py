import random
import re

from pagefold.llm import licenses

#: Labels of shorter notices that stand in a licence's text.
LONGER = {"bsd-2-clause": ("bsd",), "bsd-3-clause": ("bsd", "bsd-2-clause")}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def filler(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))


def corpus():
    r = random.Random(13)
    rows = [("", ""), (None, ""), ("the license of mit", ""), ("MIT License MIT-license; mit_license", "mit"), ("x MITLicense É license", ""), ("apache\x00license general public\nlicense", "apache,gpl")]
    for label, text, _ in licenses.TEMPLATES:
        base = brute(text)[4]
        labels = {label, *LONGER.get(label, ()), *filter(None, base.split(","))}
        labels = {x for x in labels if not labels & set(licenses.SAYS_LESS.get(x, ()))}
        want = ",".join(sorted(labels))
        rows += [(text, want), (f"{filler(r, 50)}. {text}. {filler(r, 500)}", want), (text.upper().replace(" ", "\n * "), want)]
    rows += [(filler(r, r.randint(0, 300)), "") for _ in range(60)]
    rows += [("licensed under nothing, apache tribe, version of mit and cc and gnu", ""), ("word " * 50_000 + "Released under the MIT License.", "mit")]
    return rows


def test_rows(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "c") for i, (t, _) in enumerate(rows)] + [(None, "MIT license", "c"), (0, "", "c")], "doc_id long, text string, labels string")
    got = licenses.license_rows(df).collect()
    assert len(got) == len(rows) + 2
    for g in got:
        if g.doc_id is not None:
            text, want = rows[g.doc_id]
            assert tuple(g)[1:6] == brute(text), text
            assert g.labels == want, (text, g.labels, want)
            assert 0 <= g.score <= 1
    assert licenses.license_rows(df.limit(0)).count() == 0


def test_key_phrases_are_mandatory():
    t = next(x for x in licenses.NOTICES if x.label == "gpl-3.0")
    ws = t.words
    assert licenses.verified(ws, 0, t) == 1.0
    broken = [w if w != b"gnu" else b"new" for w in ws]
    assert licenses.verified(broken, 0, t) == 0.0
    a_word_put_in = [*ws[:3], b"hereby", *ws[3:]]
    assert licenses.verified(a_word_put_in, 0, t) == 1.0


def test_a_text_with_every_licence():
    r = random.Random(17)
    by = licenses.build({}, 1000)
    text = f" {filler(r, 20)}. ".join(t for _, t, _ in licenses.TEMPLATES)
    found = licenses.scan(text.encode(), by)
    assert set(found["labels"].split(",")) == {"apache", "gpl", *(label for label, _, _ in licenses.TEMPLATES)} - set(licenses.SAYS_LESS)


def test_a_files_rarest_words_are_looked_up():
    """A word that is common in the corpus is looked up last; one that the file lacks is not missed."""
    t = next(x for x in licenses.NOTICES if x.label == "zlib")
    common = {w: 900 for w in t.words if w != b"misrepresented"}
    by = licenses.build(common, 1000)
    assert by.rank[b"misrepresented"] < min(by.rank[w] for w in common)
    ws = [w for w in t.words if w not in (b"plainly", b"marked", b"altered", b"alter")]
    assert by.match(ws, licenses.VOCABULARY.intersection(ws)).get("zlib", 0) >= 0.7


def test_starts_close_together():
    """Anchors that stand alone right before a licence don't hide it."""
    by = licenses.build({}, 1000)
    for t in licenses.NOTICES:
        for k in range(1, 8):
            ws = [*t.words[:1] * k, *t.words[1:3], *t.words]
            assert t.label in by.match(ws, licenses.VOCABULARY.intersection(ws)) or t.label in licenses.SAYS_LESS, (t.label, k)


def altered(r, ws, share):
    out = []
    for w in ws:
        x = r.random()
        out += [] if x < share / 3 else [b"other"] if x < 2 * share / 3 else [w, b"more"] if x < share else [w]
    return out


def test_recall_on_altered_texts():
    """Words changed, left out and put in; mandatory phrases stay whole. 29 of 30 are found, and nothing in texts without a licence."""
    r, n, hit = random.Random(19), 0, 0
    by = licenses.build({}, 1000)
    for t in licenses.NOTICES:
        for _ in range(20):
            ws, spans = t.words, [(at, at + len(k)) for k in t.keys for at in licenses.places(t.words, k)[:1]]
            keep = [any(a <= i < z for a, z in spans) for i in range(len(ws))]
            new = [x for i, w in enumerate(ws) for x in ([w] if keep[i] else altered(r, [w], 0.08))]
            whole = [w.encode() for w in filler(r, 30).split()] + new + [w.encode() for w in filler(r, 30).split()]
            labels = set(by.match(whole, licenses.VOCABULARY.intersection(whole)))
            n, hit = n + 1, hit + bool(labels & {t.label, *licenses.SAYS_LESS.get(t.label, ())})
    assert hit >= 0.97 * n, (hit, n)
    words = sorted(licenses.VOCABULARY)
    for _ in range(200):
        ws = r.choices(words, k=300)
        assert not by.match(ws, licenses.VOCABULARY.intersection(ws))
