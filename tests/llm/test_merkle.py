import hashlib
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lorekeep.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, digest string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(items, arity):
    """(root, for each item its path of (left, right))."""
    paths, groups = [[] for _ in items], [[i] for i in range(len(items))]
    while len(items) > 1:
        above, merged = [], []
        for b in range(0, len(items), arity):
            run = items[b : b + arity]
            for j in range(len(run)):
                for i in groups[b + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            above.append(digest(*run))
            merged.append([i for g in groups[b : b + arity] for i in g])
        items, groups = above, merged
    return items[0], paths


def plain(rows, arity):
    """doc_id, source, leaf, subroot, root, digest of the proof, root folded from the tampered leaf."""
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row[:5])
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(plain_tree([leaf(r) for r in by[name]], arity))
    root, above = plain_tree([t[0] for t in trees], arity)
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    out = []
    for name, (subroot, paths), top in zip(names, trees, above, strict=True):
        for row, path in zip(by[name], paths, strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            folded = leaf((*row[:4], row[4].translate(lower)) if hit else row)
            for left, right in path + top:
                folded = digest(*left, folded, *right)
            proof = digest(*(x for left, right in path + top for x in left + right))
            out.append((row[0], row[1], leaf(row), subroot, root, proof, folded, folded == root))
    return out


def rows_of(rng, n):
    rows = [(None, None, None, None, None), (0, "", "", 0, ""), (1, "big", "é", 3, "A\0É")]
    for i in range(2, n):
        source = "big" if i % 3 else rng.choice([None, "", "=", "é", "z", "Z", "a b"])
        rows.append((i, source, rng.choice(["en", None]), i, "".join(rng.choice("abcXYZé€ \n") for _ in range(rng.randint(0, 30)))))
    rows.append((n, "long", "en", None, "Wörd " * 200_000))
    rows += [rows[5], rows[5], (6, "big", "en", 1, "another text of that id")]
    return [(*r, "x", 7, "y") for r in rows]


def found(spark, rows, arity):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return merkle.verify(merkle.build(docs, {"claimed": merkle.tampered(docs)}, arity=arity), "claimed")


def test_against_brute_force(spark):
    rng = random.Random(12)
    for arity, n in ((16, 320), (2, 25)):
        rows = rows_of(rng, n)
        got = found(spark, rows, arity)
        columns = ("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
        assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(plain(rows, arity))


def test_one_row_and_empty_tables(spark):
    one = [(7, "s", "en", 1, "x", "t", 1, "d")]
    got = found(spark, one, 16).first()
    assert got.leaf == got.subroot == got.root == got.folded_root == leaf(one[0][:5]) and got.verified
    assert got.proof_sha256 == digest()
    empty = spark.createDataFrame(one, SCHEMA).where("false")
    assert merkle.manifest(empty).count() == 0
    assert merkle.build(empty).root is None


def test_any_change_of_a_field_shows(spark):
    rows = [(i, "s", "en", 5, f"text {i}", "t", 1, "d") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, other in (("source", F.lit("r")), ("lang", F.lit(None).cast("string")), ("n_chars", F.lit(6)), ("text", F.concat("text", F.lit(" ")))):
        claimed = merkle.leaf([other if c == name else F.col(c) for c in merkle.FIELDS])
        got = merkle.verify(merkle.build(docs, {"claimed": claimed}), "claimed")
        assert got.where("verified").count() == 0


def test_siblings_are_slot_offsets(spark):
    frame = spark.range(1).select(F.sort_array(merkle.slot_siblings(F.lit(18).cast("long"), 16)), merkle.slot_siblings(F.lit(6).cast("long"), 2))
    many, two = frame.first()
    assert many == [16, 17, *range(19, 32)] and two == [7]
