"""The encoders of words do little work a word."""

from gatherline.llm import catalog, packing, pieces


class Counted(dict):
    n = 0

    def get(self, *a):
        self.n += 1
        return super().get(*a)


def test_pieces_are_found_from_their_ends():
    """op3_pieces: no lookup of every substring of a word."""
    m = pieces.Pieces(catalog.tokenizer("piece_bpe_32k.model"))
    want = m.encode(["some words, zzqxjk ▁ é日 and words"])[0].tolist()
    m.known, m.score = {}, Counted(m.score)
    assert m.encode(["some words, zzqxjk ▁ é日 and words"])[0].tolist() == want and m.score.n < 10
    assert m.decode(want) == "some words, zzqxjk ▁ é日 and words" and m.encode([""])[0].tolist() == m.segment(["▁"])[0]


def test_words_that_end_in_marks():
    """op4_packing: the tokenizer sees each run of marks once, not each word that ends in it."""
    e = packing.Encoder(catalog.tokenizer("word_bpe_49k.json"))
    words = [f"{a}{b}{c}{m}" for a in "abcd" for b in "efghé" for c in "ijß" for m in ("", "!", "!!", "&&&", ",###", "***", ")].", "'s", "_", "'")]
    want = [e.whole.encode(w, add_special_tokens=False).ids for w in words]
    calls, ids = [], e._ids
    e._ids = lambda text: calls.append(text) or ids(text)
    for texts in (words[::-1], words, [" ".join(words)]):
        got = e.encode(texts)
        assert [x for w in got for x in w.tolist()] == [x for w in (want[::-1] if texts == words[::-1] else want) for x in w]
    marks = [c for c in calls if not c[0].isalpha()]
    assert len(marks) == len(set(marks)) == 6 and not [c for c in calls if c.endswith(("!!", "&&&", "###")) and c[0].isalpha()]
