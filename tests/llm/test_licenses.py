"""Every license rule against the gate and the keywords that decide whether it runs."""

import itertools
import random
import re
import re._parser as parser

from lodestone.llm import licenses


def samples(pattern):
    """Texts that a pattern matches: all its branches, with and without each optional part."""

    def of(tree):
        parts = []
        for kind, value in tree:
            name = str(kind)
            if name == "LITERAL":
                parts.append([chr(value)])
            elif name == "IN":
                parts.append([chr(c) for k, c in value if str(k) == "LITERAL"])
            elif name == "SUBPATTERN":
                parts.append(of(value[3]))
            elif name == "BRANCH":
                parts.append([t for branch in value[1] for t in of(branch)])
            elif name == "MAX_REPEAT":
                parts.append(([""] if value[0] == 0 else []) + of(value[2]))
            else:
                raise ValueError(name)
        return ["".join(p) for p in itertools.product(*parts)]

    return of(parser.parse(pattern))


def words_of(text):
    return re.sub("[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " ", (text or "").translate({c: c + 32 for c in range(65, 91)})).strip(" ")


def test_every_rule_is_reached():
    """Every text of every signature holds a gate word and a keyword of its family, and the family's expression finds it."""
    n, missed = 0, []
    for family, group in zip(licenses.FAMILIES, licenses.families()):
        held = licenses.signatures(family)
        assert len(held) == len(group["rules"])
        bare = [t for n in (*family.names, *family.texts) for t in samples(n)] + [f"license {t}" for n in family.ids for t in samples(n)]
        for text in [*bare, *(min(samples(p), key=len) for p, _ in held)]:
            n += 1
            line = f" {text} "
            if not re.search(group["pattern"], line) or not any(k in line for k in group["keywords"]) or not any(g in line for g in licenses.GATE):
                missed.append(text)
    assert n > 1000 and not missed, missed
    assert all(any(g in phrase for g in licenses.GATE) for phrase, _ in licenses.BASE)


def brute(text):
    """Labels and score without any gate: all places of all families, then the suppression."""
    line = f" {words_of(text)} "
    places = []
    for group in licenses.families():
        for m in re.finditer(group["pattern"], line):
            start = line[: m.start()].count(" ")
            rule = next(r for r in group["rules"] if re.search(r["whole"], m.group()))
            places.append((start, -(start + m.group().count(" ")), rule["rank"], group["label"], rule["sure"]))
    reach, labels, score = 0, set(), 0.0
    for start, back, _, label, sure in sorted(places):
        if -back > reach:
            reach, score = -back, max(score, sure)
            labels.add(label)
    for phrase, label in licenses.BASE:
        if f" {phrase} " in line:
            labels.add(label)
            score = 1.0
    return ",".join(sorted(labels)), score


def test_gated_scan_equals_an_ungated_one(documents):
    rnd = random.Random(9)
    signature = [p for f in licenses.FAMILIES for p, _ in licenses.signatures(f)]
    phrases = [rnd.choice(samples(p)) if len(p) < 250 else min(samples(p), key=len) for p in signature]
    filler = [*"the and of a file is under by license mit public domain bsd gpl cc version 2 0 commercial é 漢字 permit general free".split(), *(p for p, _ in licenses.BASE)]
    gaps = [" ", "_", "-", "\n", ", ", "\t(", "/", "\x00"]
    rows = []
    for i in range(len(phrases) + 400):
        parts = [rnd.choice(filler) for _ in range(rnd.randint(0, 12))]
        for _ in range(rnd.randint(0, 2)):
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(phrases))
        if i < len(phrases):
            parts.insert(rnd.randint(0, len(parts)), phrases[i])
        text = "".join(w + rnd.choice(gaps) for p in parts for w in p.split())
        rows.append((i, text.upper() if rnd.random() < 0.2 else text.title() if rnd.random() < 0.2 else text))
    got = {r["doc_id"]: (r["labels"], r["score"], r["n_words"]) for r in licenses.scan_licenses(documents(rows)).collect()}
    wrong = {t: (got[i], brute(t)) for i, t in rows if got[i] != (*brute(t), len(words_of(t).split()))}
    assert not wrong, wrong


IDENTIFIED = {
    "GFDL-1.3": "gfdl", "MIT-0": "mit-0", "EPL-2.0": "epl-2", "EPL-1.0": "epl-1", "EUPL-1.2": "eupl", "CDDL-1.0": "cddl", "BSL-1.0": "boost", "PSF-2.0": "python",
    "OFL-1.1": "ofl", "ODbL-1.0": "odbl", "MIT": "mit", "MPL-2.0": "mpl-2",
}


def test_identifiers(documents):
    rows = [(i, f"SPDX-License-Identifier: {t}") for i, t in enumerate(IDENTIFIED)]
    more = {100: ("the PSF license", "python"), 101: ("GNU Library General Public License version 2", "lgpl-2"), 105: ("the Library General Public License", "lgpl"), 102: ("a new_BSD text", "bsd-3"), 103: ("x_MPL_2.0", "mpl-2"), 104: ("OpenRAIL_M", "openrail"), 106: ("code is 3-clause_BSD today", "bsd-3")}
    found = licenses.scan_licenses(documents(rows + [(i, t) for i, (t, _) in more.items()])).collect()
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in found}
    assert {t: got[i][0] for i, t in enumerate(IDENTIFIED)} == IDENTIFIED
    assert all(got[i][1] == 0.98 for i in range(len(IDENTIFIED)))
    assert {i: got[i][0] for i in more} == {i: v for i, (_, v) in more.items()}
