import math
import random
import re

import pytest

from lodestar.llm.pii import BASE, FEATURES, KINDS, PSEUDO, VOTERS, candidates, find_pii, reliabilities, span_classifier

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def check(docs, rows):
    got = find_pii(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(base_spans(t or ""))
    for r in got:
        own = r.base.split(",") if r.base else []
        assert own in want[r.doc_id], (r, want[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s.startswith(k + ":") for s in own) for k in KINDS]
        every = r.spans.split(",") if r.spans else []
        assert set(own) <= set(every) and len(every) - len(own) == r.n_added and r.n_spans == len(every)
    return {r.doc_id: r for r in got}


def test_base_against_plain_patterns(documents):
    rng = random.Random(7)
    bits = ["bo.x_1@mail8.example.com", "a@b", "a@b.c@d.e", "é@x.fr", "42.144.35.254", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "007.1.2.3", "4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795", "4041  8949", "+1 (988) 555-2485", "+44.20 7946-0958.", "++12 3456 7890 1", "+1-2-3", "🙂", "version 2.0", "%.@x-.y.z", "12345678901234567890123"]
    rows = [(k, "".join(rng.choice(bits) + rng.choice(["", " ", "\n", ",", "x", "@", "."]) for _ in range(rng.randint(0, 14)))) for k in range(400)]
    check(documents(rows), rows)


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (3, "7" * 60_000), (4, "a" * 60_000), (5, "1.1.1.1 " * 500), (6, "a.b" * 20_000 + "@c.d"), (7, "x@y.zz"), (7, "x@y.zz"), (7, "other +1 234 567 8901")]
    check(documents(rows), rows)
    assert find_pii(documents([(1, "a")]).where("doc_id = 2")).count() == 0


def planted(rng, n):
    """Texts with base spans as people write them, texts with hidden ones and texts with numbers that are nobody's: (text, kinds of hidden spans)."""
    names = ["jo.doe", "ann_lee", "k.meier", "maria.ruiz", "p.dupont", "sam99"]
    hosts = ["site", "mail-host", "uni-ulm", "acme"]
    ends = ["com", "org", "de", "fr"]
    phone = lambda: (rng.randint(201, 989), rng.randint(201, 989), rng.randint(0, 9999))
    out = []
    for _ in range(n):
        kind = rng.random()
        name, host, end, (a, b, c) = rng.choice(names), rng.choice(hosts), rng.choice(ends), phone()
        tail = rng.choice(["", " thanks", " before noon", ", anytime"])
        if kind < 0.3:
            out.append((f"please mail me: {name}{rng.randint(1, 99)}@{host}.{end}{tail}", []))
        elif kind < 0.55:
            out.append((f"{rng.choice(['call', 'phone', 'my tel'])} +1 ({a}) {b}-{c:04d}{tail}", []))
        elif kind < 0.65:
            at, dot = rng.choice(["[at]", "(at)", "[AT]"]), rng.choice([".", " [dot] ", " (dot) "])
            out.append((f"{rng.choice(['please mail me:', 'contact'])} {name} {at} {host}{dot}{end}{tail}", ["email"]))
        elif kind < 0.75:
            out.append((f"{rng.choice(['call', 'phone', 'my tel'])} {rng.choice([f'({a}) {b}-{c:04d}', f'{a}-{b}-{c:04d}', f'{a}.{b}.{c:04d}'])}{tail}", ["phone"]))
        elif kind < 0.8:
            v6 = ":".join(f"{rng.randint(1, 65535):x}" for _ in range(7))
            out.append((f"from host 2001:{v6} today", ["ip"]))
        else:
            number = rng.choice([f"{a}-{b}-{c:04d}", f"{a}.{b}.{c:04d}", f"{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}-{rng.randint(10, 99)}"])
            out.append((f"{rng.choice(['see order', 'invoice', 'serial', 'part no', 'release'])} {number} {rng.choice(['units', 'pieces', 'of it', 'shipped'])}", []))
    return out


def test_recall_and_precision_of_added_spans(documents):
    """Labelers disagree here: order numbers look like telephone numbers, and some hidden spans have no telling word beside them."""
    texts = planted(random.Random(21), 1200)
    rows = [(k, t) for k, (t, _) in enumerate(texts)]
    got = check(documents(rows), rows)
    hidden = {k: len(kinds) for k, (_, kinds) in enumerate(texts) if kinds}
    found = {k for k, r in got.items() if r.n_added}
    right = [k for k in found if hidden.get(k) == got[k].n_added and got[k].spans.split(":")[0] == texts[k][1][0]]
    assert len(hidden) > 200
    assert len(right) >= 0.9 * len(hidden) and len(right) >= 0.95 * len(found)


def test_loose_spans_are_added_with_context_and_clean_text_left_alone(documents):
    rows = [(k, f"please mail u{k}@site.com today") for k in range(200)] + [(200 + k, f"call phone +1 (234) 555-{1000 + k} now") for k in range(200)]
    rows += [(900, "please mail me: jo.doe [at] site [dot] com thanks"), (901, "phone: (234) 555-9876 now"), (902, "see version 2.0 and section 3.1.4 of 1998-2004"), (903, "a quiet text")]
    got = check(documents(rows), rows)
    assert got[900].spans == "email:16:42" and got[901].n_added == 1 and got[901].n_spans == 1
    assert got[902].spans == "" and got[903].spans == ""


def test_reliabilities_find_the_labeler_that_guesses():
    """Votes drawn from known accuracies: the estimates come near, and probabilities follow the labels."""
    rng = random.Random(2)
    accuracy = [0.95, 0.9, 0.85, 0.5, 0.9, 0.8, 0.75]
    counts, truth = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.6
        votes = tuple(-1 if rng.random() < 0.2 else int(y == (rng.random() < a)) for a in accuracy)
        counts[votes] = counts.get(votes, 0) + 1
        truth[votes] = truth.get(votes, 0) + y
    share, coins, post = reliabilities([(0, v, n) for v, n in counts.items()])
    assert abs(share[0] - 0.6) < 0.03 and all(abs(a - x) < 0.03 and abs(1 - b - x) < 0.03 for (a, b), x in zip(coins[0], accuracy, strict=True))
    assert sum(n * abs(post[0, v] - truth[v] / n) for v, n in counts.items() if n >= 50) / sum(n for n in counts.values() if n >= 50) < 0.05


def test_classifier_against_plain_sums(documents):
    texts = planted(random.Random(4), 200)
    rows = candidates(documents([(k, t) for k, (t, _) in enumerate(texts)]))
    got = rows.collect()
    assert {v for r in got for v in VOTERS if r[v] == 0} >= {"form", "before", "after"}
    post = {(r.kind, tuple(r[v] for v in VOTERS)): (1 + len(repr(r.kind)) + sum(r[v] for v in VOTERS)) % 5 / 4 for r in got}
    model = span_classifier(rows, post)
    for k in range(len(KINDS)):
        own = [(r.features, post[k, tuple(r[v] for v in VOTERS)]) for r in got if r.kind == k]
        share = (sum(p for _, p in own) + 1) / (len(own) + 2)
        assert math.isclose(model[k][0], math.log(share / (1 - share)))
        for f in range(FEATURES):
            y, n = sum(p for fs, p in own if f in fs), sum(1 - p for fs, p in own if f in fs)
            assert math.isclose(model[k][1][f], math.log((y + PSEUDO * share) / (n + PSEUDO * (1 - share))) - math.log(share / (1 - share)), abs_tol=1e-9)


def test_candidates_carry_votes(documents):
    rows = candidates(documents([(1, "mail a@b.com"), (2, "order 10.0.0.1"), (3, "x+1 (017) 555-7713y")])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.kind, r.base, r.start, r.end, *(r[v] for v in VOTERS)) for r in rows] == [(1, 0, True, 5, 12, 1, 1, 1, -1, 1, 1, -1), (2, 1, True, 6, 14, 1, 0, 0, -1, 1, 1, -1), (3, 3, True, 1, 18, 0, 1, -1, -1, 0, 1, -1)]
    assert set(BASE) == set(KINDS) and all(0 <= f < FEATURES for r in rows for f in r.features)


HARMLESS = ["Order 213-555-0199 was shipped", "serial 305-867-5309 revision b", "invoice 646-222-3434", "ISBN 978-123-4567", "part no 718.555.0142", "version 303-404-5050", "see item 212-555-0188 of it", "hash 415-555-2671 in hex", "release 617-555-0111 is out", "figure 202-555-0173 shows"]
HIDDEN = ["please call 213-555-0199 thanks", "phone: (305) 867-5309", "my tel 646.222.3434 before noon", "contact jo.doe [at] site [dot] com"]


@pytest.mark.parametrize("clean", (0, 15))
def test_precision_where_negatives_are_few(documents, clean):
    """Base spans by the hundred, nearly all real, and few loose matches, none or a few in a hundred of them harmless: they aren't let in on the others' account."""
    rows = [(k, f"please mail u{k}@site.com today or call +1 (234) 555-{1000 + k % 9000}") for k in range(300)]
    rows += [(1000 + k, t) for k, t in enumerate(HIDDEN)] + [(3000 + k, HARMLESS[k % 10]) for k in range(clean)]
    got = check(documents(rows), rows)
    found = {k for k, r in got.items() if r.n_added}
    assert {k for k in found if 1000 <= k < 1004} == set(range(1000, 1004))
    assert len(found & set(range(3000, 3100))) <= 0.05 * len(found)


def test_harmless_numbers_of_a_corpus_without_loose_spans(documents):
    rows = [(k, f"please mail u{k}@site.com today or call +1 (234) 555-{1000 + k % 9000}") for k in range(300)]
    rows += [(3000 + k, t) for k, t in enumerate(HARMLESS)]
    assert not any(r.n_added for r in check(documents(rows), rows).values())
