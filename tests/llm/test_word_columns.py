"""Words told apart in columns: only different ones become Python objects, and texts get the ids that whole ones have."""

from test_ops import TRICKY

from vaultlens.llm import queries, token_store


def encoders():
    return [token_store.WordEncoder(queries.tokenizer_path(), 2, whole) for whole in (False, True)]


def test_a_repeated_word_is_made_once():
    words, which, first = encoders()[0]._words([b"Some word\tsome\n", b"", b" \x0b", b"WORD <|x some"])
    assert [words[i] for i in which] == [b"some", b"word", b"some", b"WORD", b"<|x", b"some"]
    assert len(words) == 4 and first.tolist() == [0, 3, 3, 3, 6]


def test_texts_of_all_kinds(monkeypatch):
    monkeypatch.setattr(token_store, "JOINED_WORDS", 3)
    own, whole = encoders()
    for texts in ([], [b""], [b" "], [b"", b"a", b"", b" \x0b b\t", b""], [t.encode() for t in TRICKY], [t.encode() for t in TRICKY[::-1]]):
        assert own.encode(texts) == whole.encode(texts)
