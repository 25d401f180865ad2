import random
import re

import pytest

from lorekeep.llm import licenses
from tests_words import tokens


def shingles(text):
    w = tokens(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def plain(text, templates):
    own, out = shingles(text), {}
    for name, body in templates.items():
        t = set(shingles(body))
        best = max((len(t & set(own[i : i + len(t)])) / len(t) for i in range(len(own))), default=0)
        if best >= 0.8:
            out[name] = best
    return out


def test_against_brute_force(spark):
    rng = random.Random(13)
    rows = [(0, None), (1, ""), (2, "MIT License."), (None, "released UNDER the mit license!")]
    for i in range(3, 80):
        body = [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 40))]
        notice = rng.choice(list(licenses.NOTICES.values())).split()
        if rng.random() < 0.5 and len(notice) > 20:
            notice[rng.randrange(len(notice))] = "changed"
        at = rng.randint(0, len(body))
        rows.append((i, " ".join(body[:at] + notice + body[at:])))
    rows.append(rows[-1])
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, template string")
    got = sorted((str(r.doc_id), r.template, round(r.containment, 9)) for r in licenses.scan(docs, licenses.NOTICES).collect())
    want = sorted((str(i), n, round(s, 9)) for i, t in rows for n, s in plain(t, licenses.NOTICES).items())
    assert got == want and len(want) > 70
    assert licenses.scan(docs.where("false"), licenses.NOTICES).count() == 0


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), {"x": "two words"})


def test_license_texts_and_bodies(spark):
    texts = {name: " ".join(body.split()) for name, body in licenses.TEXTS.items()}
    rows = [(name, f"Some words before. {body} Some words behind.") for name, body in texts.items()]
    rows += [("MIT-body", re.split(": ", texts["MIT-text"], maxsplit=1)[1]), ("BSD-3-Clause-text", re.split(": ", texts["BSD-3-Clause-text"], maxsplit=1)[1])]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    found = {(r.doc_id, r.template) for r in licenses.scan(docs, licenses.NOTICES | licenses.TEXTS).collect()}
    assert all((i, name) in found for i, (name, _) in enumerate(rows))
    for name in ("AGPL-3.0-notice", "LGPL-3.0-notice", "MPL-2.0-notice", "CC-BY-SA-4.0-notice"):
        assert name in licenses.NOTICES


def test_a_notice_gives_its_own_license_alone(spark):
    given = licenses.NOTICES
    names = sorted(given)
    rows = [(i, f"Some words stand before. {given[n]} And some stand behind.") for i, n in enumerate(names)]
    rows += [(100, f"{given['GPL-3.0-notice']} {'between ' * 60} {given['AGPL-3.0-notice']}"), (None, given["MPL-2.0-notice"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.best_in_place(licenses.scan(docs, given), given)
    assert got.columns == ["doc_id", "template", "containment", "first_word", "n_words"]
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, set()).add(r.template)
    for i, name in enumerate(names):
        assert found[i] <= {name, name.removesuffix("-notice")} and name in found[i] or name == "Apache-2.0"
    assert found[100] == {"GPL-3.0-notice", "AGPL-3.0-notice"} and found[None] == {"MPL-2.0-notice"}


def test_long_license_texts(spark):
    given = licenses.NOTICES | licenses.TEXTS
    name = max(licenses.TEXTS, key=lambda n: len(licenses.TEXTS[n]))
    text = licenses.TEXTS[name]
    docs = spark.createDataFrame([(n, f"{'word ' * 20_000} " + " ".join([text] * n)) for n in (1, 3)], "doc_id long, text string")
    got = {(r.doc_id, r.template): r for r in licenses.best_in_place(licenses.scan(docs, given), given).collect()}
    for n in (1, 3):
        # A place has as many shingles as the template has different ones, and this text repeats some; of several
        # copies in a row a place may reach over the end of one.
        assert got[n, name].containment > 0.97 and got[n, name].first_word >= 20_000
