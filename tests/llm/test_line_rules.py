"""Quality rules on closing punctuation and link-like lines: hand cases, and random texts against SQL."""

import random

from quarry.llm import op9_quality_rules as op9

PROSE = "\n".join(f"The {w} report describes what happened during the long meeting in town." for w in ("first", "second", "third", "fourth", "fifth", "sixth"))

#: name -> (text, lines that go)
CASES = {
    "menu": (f"Home\nAbout us\nContact\n{PROSE}", ["Home", "About us", "Contact"]),
    "menu at the end": (f"{PROSE}\nHome\n \nAbout us\nContact\nSign in here", ["Home", "About us", "Contact", "Sign in here"]),
    "menu among prose, once more by itself": (PROSE.replace("\n", "\nInicio\nNoticias\nDeportes hoy\n", 1) + "\nInicio", ["Inicio", "Noticias", "Deportes hoy"]),
    "a pair of titles": (f"Home\nAbout us\n{PROSE}", []),
    "titles apart": (PROSE.replace("\n", "\nA title\n"), []),
    "items with numbers": (f"2 eggs\n100 g flour\n1 lemon\n{PROSE}", []),
    "verse that closes": (f"Roses are red,\nviolets are blue,\nsugar is sweet;\n{PROSE}", []),
    "lines without blanks": (f"{'語' * 41}\n{'語' * 42}\n{'語' * 43}\n{PROSE}", []),
    "teaser": (f"{PROSE}\nTen things that you should know now", ["Ten things that you should know now"]),
    "closes after white space": (f"{PROSE}\nTen things that you should know now! \r", []),
    "other alphabets close": (f"{PROSE}\nЭто очень важно знать всем людям»\nهذا ما يجب أن تعرفه اليوم؟", []),
    "a long paragraph without full stop": (f"{PROSE}\n{'word and another ' * 8}end", []),
    "text that doesn't close its lines": ("\n".join(f"verse number {w} goes on without any stop" for w in "abcdefgh"), []),
    "too few closed lines": (PROSE[:PROSE.index("\nThe fifth")] + "\nTen things that you should know now", []),
}


def test_hand_cases(docs_of):
    got = {r.doc_id: r for r in op9.quality(docs_of([(k, t) for k, (t, _) in enumerate(CASES.values())])).collect()}
    for k, (name, (text, gone)) in enumerate(CASES.items()):
        want = [x for x in dict.fromkeys(text.split("\n")) if x.strip() and x not in gone]
        assert got[k].cleaned.split("\n") == want, name


def test_random_lines_equal_sql(docs_of, same):
    r = random.Random(11)
    pieces = ["Home", "About us", "Contact", "a b c d", "one two three four five", "one two three four five six.", "it ends here, really, it does!", "4 eggs", " ", "\r", "語。", "語", "x" * 41,
              "word " * 21, "Next »", "Tab\there"]
    rows = [(k, "\n".join(r.choice(pieces[:r.randint(3, len(pieces))]) for _ in range(r.randint(0, 25)))) for k in range(400)]
    rows += [(900, None), (901, ""), (902, "Home\n" * 5000), (903, "\n".join(f"item {chr(97 + k % 26)}{'x' * (k % 30)}" for k in range(3000)))]
    d = docs_of(rows)
    same(op9.rules(d), op9.ORACLE, documents=d.toPandas())
