"""The field of the secret scan finds what no pattern covers."""

import random
import string

from tenderlake.llm import secrets as S

HEX, MIXED = "0123456789abcdef", string.ascii_letters + string.digits
PLAIN = ["https://example.com/docs/2024/05/intro.html", "1.2.33", "12,000", "2024-05-06", "10:30:15", "someCamelCase",
         "SOME_CONSTANT", "file_name_2.py", "chapter: one", "x = 3", "(see", "O'Neill", "user: me", "the token", "3rd"]


def _words(r, n):
    return " ".join(r.choice(PLAIN) if r.random() < 0.1 else
                    "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 11))) for _ in range(n))


def _value(r, chars=MIXED):
    return "".join(r.choice(chars) for _ in range(r.randint(20, 40)))


def _labelled(r):
    return r.choice([f'token = "{_value(r, HEX)}"', f"password: {_value(r)}", f"api_key={_value(r)}",
                     "AKIA" + "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(16))])


def _corpus(n, n_labelled, seed):
    r = random.Random(seed)
    return [f"{_words(r, 40)} {_labelled(r) if i < n_labelled else ''} {_words(r, 30)}" for i in range(n)]


def _added(text, field):
    return [text[s:e] for k, s, e in zip(*S.spans(text, field)) if S.KINDS[k] == "crf"]


def test_secrets_beside_the_patterns_are_found():
    field, r = S.Field(S.fit_rows(_corpus(500, 150, 1))), random.Random(2)
    found, forms = 0, ("Authorization: Bearer {}", "the password is {} and", "use ghp_{} for", "key -> '{}' was",
                       "login admin:{} on", "hidden {} here")
    for i in range(300):
        value = _value(r)
        text = f"{_words(r, 20)} {forms[i % len(forms)].format(value)} {_words(r, 20)}"
        assert not S.base_spans(text) or i % len(forms) == 0
        found += any(value in x for x in _added(text, field))
    assert found >= 270
    clean = [_words(r, 60) for _ in range(300)]
    assert sum(len(_added(t, field)) for t in clean) <= 3


def test_rest_of_a_run_stays_beside_the_base_span():
    class All:
        def tags(self, tokens, file):
            return {i: S.INSIDE if i else S.BEGIN for i in range(len(tokens))}
    text = "password: abcdef@ghi!jkl"
    kinds, starts, ends = S.spans(text, All())
    assert [(S.KINDS[k], text[s:e]) for k, s, e in zip(kinds, starts, ends)] == [
        ("assign", "password: abcdef"), ("crf", "@ghi!jkl")]


def test_rare_labels_reach_the_sample(spark):
    """Three labelled documents of 2,000; ten documents are learnt from."""
    texts = _corpus(2000, 3, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert S.fit(df, max_docs=10) is not None
    assert S.fit(df.where("doc_id >= 3"), max_docs=10) is None


def test_very_long_text():
    field = S.Field(S.fit_rows(_corpus(200, 60, 4)))
    text = _words(random.Random(5), 60_000) + " secret=" + _value(random.Random(6))
    kinds, starts, ends = S.spans(text, field)
    assert (S.KINDS.index("assign"), ends[-1]) == (kinds[-1], len(text))
