"""What Python workers remember: of one operator at a time, as a worker serves all stages of a pipeline."""

import gc
import weakref

from corpusloom.llm import common, ngram_join, packing, sentencepieces


def test_an_operator_lets_go_what_others_remember():
    vocabulary = sentencepieces.default_model()
    encoder = weakref.ref(sentencepieces.encoder(vocabulary))
    assert sentencepieces.encoder(vocabulary) is encoder()  # serves the operator's later tasks
    list(ngram_join.token_sets(["one two three four"], 2))
    gc.collect()
    assert encoder() is None
    packer = weakref.ref(packing._encoder(packing.default_tokenizer(), 1))
    assert packing._encoder(packing.default_tokenizer(), 1) is packer()
    sentencepieces.encoder(vocabulary).encode_batch(["one two"])
    gc.collect()
    assert packer() is None


def test_digests_of_words_stay_when_memory_is_let_go(monkeypatch):
    words = [b"a", b"b", b"a", b"c"]
    before = common.word_hashes(words)
    monkeypatch.setattr(common, "WORDS", 1)
    for _ in range(3):
        assert (common.word_hashes(words) == before).all()
    common.forget()
    assert (common.word_hashes(words) == before).all()
