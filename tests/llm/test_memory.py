"""What keeps a worker's memory small doesn't change what it gives."""

from quire.llm import common, tokens

PATH = tokens.default_path()


def test_encoder_of_small_slices():
    texts = ["word " * 3000 + "end. Größe, l'été 12", "", None, "a  b\n\nc " * 900, "Wörter, and marks! " * 2000]
    whole, ends = tokens.encoder(PATH).encode(texts)
    some, same_ends = tokens.encoder(PATH, 50, 1 << 12).encode(texts)
    assert whole.tolist() == some.tolist() and ends.tolist() == same_ends.tolist()
    common.MEMOS["tokens"]()  # what other operators forget: the encoder and its tables of powers
    assert not tokens._MEMO and not tokens._POWERS
