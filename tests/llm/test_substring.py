import random

from lorekeep.llm import substring


def plain(rows, m):
    """Brute force: every series of units of at least m words that is minimal at either end, looked up in all texts."""
    cut = substring.cutter()
    seen, gone = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        parts = substring.units(rows[i][1] or "", cut)
        for a in range(len(parts)):
            for b in range(a, len(parts)):
                size = [len(p[2]) for p in parts[a : b + 1]]
                if sum(size) >= m and (sum(size[:-1]) < m or sum(size[1:]) < m):
                    key = tuple(w for p in parts[a : b + 1] for w in p[2])
                    seen.setdefault(key, []).append((i, parts[a][0], parts[b][1]))
    for found in seen.values():
        for i, a, b in found[1:] if len(found) > 1 else []:
            if (i, a, b) != min(found, key=lambda x: (order.index(x[0]), x[1])):
                gone.setdefault(i, set()).update(range(a, b))
    return ["".join(c for k, c in enumerate(t) if k not in gone.get(i, ())) if t else t for i, (_, t, _) in enumerate(rows)]


def prose(rng, n):
    out = []
    while n > 0:
        k = min(n, rng.randint(1, 9))
        words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 5))) for _ in range(k)]
        out.append(" ".join([words[0].capitalize(), *words[1:]]) + ".")
        n -= k
    return " ".join(out)


def test_against_brute_force(spark):
    rng = random.Random(6)
    shared = [prose(rng, 30) for _ in range(4)]
    rows = [(0, None, "x"), (1, "", "x"), (2, " \n ", "x"), (3, "Go Go Go Go Go Go Go Go Go Go Go Go", "x")]
    for i in range(4, 40):
        text = prose(rng, rng.randint(5, 40))
        for _ in range(rng.randint(0, 2)):
            at = rng.choice([0, len(text), text.find(" ") + 1])
            text = text[:at] + rng.choice(shared) + rng.choice([" ", "\n"]) + text[at:]
        rows.append((i, text, "x"))
    rows.append((None, shared[0], "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    got = {r.doc_id: r for r in substring.remove_repeats(docs, min_words=10).collect()}
    for (i, text, _), want in zip(rows, plain(rows, 10), strict=True):
        assert got[i].text == want
        cut = set().union(*(range(s.begin, s.end) for s in got[i].removed)) if got[i].removed else set()
        assert text is None or "".join(c for k, c in enumerate(text) if k not in cut) == want
    for passage in shared:
        assert sum(passage in (r.text or "") for r in got.values()) == 1


def test_repeated_rows_and_empty_tables(spark):
    rng = random.Random(7)
    text = prose(rng, 60)
    docs = spark.createDataFrame([(1, text), (1, text), (1, "Other. " + text), (2, text.upper())], "doc_id long, text string")
    rows = sorted((r.doc_id, r.text) for r in substring.remove_repeats(docs).collect())
    tags = {r.text: r.tag for r in docs.selectExpr("text", "hash(text) tag").collect()}
    if tags[text] < tags["Other. " + text]:  # rows of one id come in the order of their texts' hashes
        wanted = [(1, "Other."), (1, text), (1, text), (2, "")]
    else:
        wanted = [(1, ""), (1, ""), (1, "Other. " + text), (2, "")]
    assert [(i, t.strip()) for i, t in rows] == sorted(wanted)
    assert substring.remove_repeats(docs.where("false")).count() == 0
    assert substring.remove_repeats(docs.where("false")).columns == ["doc_id", "text", "removed"]


def plain_words(rng, n):
    return ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 6))) for _ in range(n)]


def test_passages_within_sentences(spark):
    rng = random.Random(8)
    passages = [plain_words(rng, n) for n in (50, 51, 60, 73) for _ in range(8)]
    for passage in passages[::2]:  # a sentence ends within
        at = rng.randrange(1, 49)
        passage[at - 1 : at + 1] = [passage[at - 1] + ".", passage[at].capitalize()]
    rows = []
    for passage in passages:
        for _ in range(3):  # mid-sentence on either side
            rows.append((len(rows), " ".join([*plain_words(rng, rng.randint(1, 30)), *passage, *plain_words(rng, rng.randint(1, 30))])))
    got = dict(tuple(r) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect())
    for k, passage in enumerate(passages):
        own = [" ".join(passage[i : i + substring.WINDOW + 1]) for i in range(len(passage) - substring.WINDOW)]
        first, *others = (got[i] for i in range(3 * k, 3 * k + 3))
        assert first == rows[3 * k][1]
        assert not any(part in text for text in others for part in own)


def test_units_cover_the_words():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "C", "É", " ", " ", "\x1c", "\n", ". "]) for _ in range(rng.randint(0, 400)))
        parts = substring.units(text, substring.cutter())
        assert [w for _, _, words in parts for w in words] == text.lower().split()
        assert all(text[a:b].lower().split() == words for a, b, words in parts)
        assert all(b <= a for (_, b, _), (a, _, _) in zip(parts, parts[1:]))


def test_digests_are_those_of_words():
    rng = random.Random(10)
    cut, spans, seen = substring.cutter(), substring.Spans(), {}
    for _ in range(60):
        text = "".join(rng.choice(["aB", "É", "İ", "🙂", "Σ", " ", " ", "\x1c", "\n", ". "]) for _ in range(rng.randint(0, 300)))
        words, found = text.lower().split(), substring.Words(text, cut, spans)
        assert [text[a:b].lower() for a, b in zip(found.begins, found.ends)] == words
        begins, ends = substring.runs(found.firsts, 3)
        assert len({*zip(begins.tolist(), ends.tolist())}) == len(begins)
        for a, b, h in zip(begins, ends, zip(spans.hashes(found.hashes, begins, ends), spans.checks(found.hashes, begins, ends))):
            assert seen.setdefault(tuple(words[a:b]), h) == h
    assert len(set(seen.values())) == len(seen) > 1000


def test_rows_alike_keep_their_text(spark):
    text = prose(random.Random(11), 60)
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, text + "\n" + text)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.text.strip()) for r in substring.remove_repeats(docs).collect())
    assert rows == [(1, text), (1, text), (2, ""), (3, "")]
