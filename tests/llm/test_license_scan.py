import random
import re

from catalogspark.llm import license_scan as ls


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def all_places(notice, words):
    """(first word, last word, edits) of every run of words within the bound, by the plain distance of all runs."""
    out = []
    for a in range(len(words)):
        for b in range(a, len(words)):
            run = " ".join(words[a:b + 1])
            if len(run) > len(notice.text) + notice.edits:
                break
            if len(run) >= len(notice.text) - notice.edits and (d := distance(notice.text, run)) <= notice.edits:
                out.append((a, b, d))
    return out


def base_of(words):
    starts, labels = [], set()
    for phrase, label in ls.BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def edit(rnd, text, times):
    for _ in range(times):
        at = rnd.randrange(len(text))
        text = rnd.choice([text[:at] + text[at + 1:], text[:at] + rnd.choice("xy é7字") + text[at:], text[:at] + rnd.choice("qz ß") + text[at + 1:]])
    return text


def test_edited_notices_against_all_runs_of_words(spark):
    rnd = random.Random(8)
    wanted = ls.notices()
    filler = "permit license mit licensed the gnu general public of cc by apache and software version 2 0 lizenz straße 字 free terms".split()
    rows = []
    for i in range(260):
        words = [rnd.choice(filler) for _ in range(rnd.randrange(0, 12))]
        for _ in range(rnd.randrange(0, 3)):
            notice = rnd.choice(wanted)
            words.insert(rnd.randrange(len(words) + 1), edit(rnd, notice.text.title(), rnd.randrange(0, notice.edits + 3)))
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(words)))
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    fuzzy = 0
    for i, text in rows:
        words, raw = split(text), text.encode()
        assert got[i].n_words == len(words)
        by = {}
        for m in got[i].matches:
            by.setdefault(m.notice, []).append(m)
            inside = split(raw[m.begin:m.end].decode())
            assert inside == words[m.first_word:m.last_word + 1]
            assert distance(wanted[m.notice].text, " ".join(inside)) == m.edits <= wanted[m.notice].edits
        for k, notice in enumerate(wanted):
            places, held = all_places(notice, words), by.get(k, [])
            if not notice.edits:
                assert sorted((m.first_word, m.last_word, 0) for m in held) == places
                continue
            fuzzy += len(held)
            assert min((p[2] for p in places), default=None) == min((m.edits for m in held), default=None)
            for a, b, _ in places:  # every place is reported or overlaps one that is no worse
                assert any(m.first_word <= b and a <= m.last_word for m in held)
            assert all(x.last_word < y.first_word for x, y in zip(held, held[1:], strict=False))
    assert fuzzy > 100


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in ls.license_labels(docs).collect()}
    wanted = ls.notices()
    assert len(got) == docs.count()
    seen = 0
    for r in docs.collect():
        words, g = split(r.text), got[r.doc_id]
        n, first, last, labels = base_of(words)
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(words), n, first, last, labels)
        assert set(filter(None, labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1 and (g.score > 0) == (g.labels != "")
        seen += n > 0
        if len(words) < 60:
            best = max((1 - p[2] / len(x.text) for x in wanted for p in all_places(x, words)), default=0)
            assert abs(g.score - best) < 1e-12
    assert seen


def test_labels_of_edited_notices(spark):
    rows = [
        (1, "Released under the MIT Licence."), (2, "permit license"), (3, "CC BY cc-by CC BY-NC"), (4, "GNU General Publik Licence v3"), (5, "THE GNU GENERAL\nPUBLIC  LICENSE; Apache License"),
        (6, "Permission is hereby granted, free of charge, to any person obtaining copies of this software"), (7, None), (8, ""), (9, "..."), (None, "MIT License"), (9, "MIT License MIT License"), (10, "x " * 300_000 + "mit license"), (11, "ccby"), (12, "mitlicense"),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_words int, labels string").repartition(2)
    got = sorted([(r.doc_id or 0, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 3)) for r in ls.license_labels(df).collect()], key=repr)
    want = [
        (1, 0, None, None, "", "mit", 0.909), (2, 0, None, None, "", "", 0.0), (3, 3, 0, 4, "cc-by", "cc-by", 1.0), (4, 0, None, None, "", "gpl", 0.923), (5, 2, 1, 5, "apache,gpl", "apache,gpl", 1.0),
        (6, 0, None, None, "", "mit", 0.945), (7, 0, None, None, "", "", 0.0), (8, 0, None, None, "", "", 0.0), (9, 0, None, None, "", "", 0.0), (0, 1, 0, 0, "mit", "mit", 1.0), (9, 2, 0, 2, "mit", "mit", 1.0), (10, 1, 300_000, 300_000, "mit", "mit", 1.0), (11, 0, None, None, "", "", 0.0), (12, 0, None, None, "", "mit", 0.909),
    ]
    assert got == sorted(want, key=repr)
    spans = ls.license_spans(df.where("doc_id = 4")).collect()
    assert [(s.label, rows[3][1][s.begin:s.end], s.edits) for s in spans] == [("gpl", "GNU General Publik Licence", 2)]
    assert ls.license_labels(df.limit(0)).count() == 0
    assert all(r.matches == [] for r in ls.scan(df, []).collect())
