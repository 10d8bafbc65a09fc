"""The quick forms of op4's steps give what the plain formulas give."""

import numpy as np
import public_tokenizers
import sentencepiece

from tripmill.llm import attention_lm as lm

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_loss(w, biases, inputs, targets):
    """Mean loss in 64 bits, position by position."""
    total, n = 0.0, 0
    for ids, goals in zip(inputs, targets):
        x = w["embed"][ids] + w["place"]
        for k, goal in enumerate(goals):
            if goal < 0:
                continue
            at = lm.CONTEXT - lm.STRIDE + k
            seen = [p for p in range(at + 1) if ids[p] != lm.PAD_ID]
            scores = x[at] @ w["query"] @ (x[seen] @ w["key"]).T / lm.WIDTH**0.5
            share = np.exp(scores) / np.exp(scores).sum()
            hidden = x[at] + share @ (x[seen] @ w["value"]) @ w["join"]
            for level in range(lm.LEVELS):
                behind = goal // lm.DIGIT ** (lm.LEVELS - 1 - level)
                logits = hidden @ w[f"out{level}"][behind // lm.DIGIT] + biases[level][behind // lm.DIGIT]
                total += np.log(np.exp(logits).sum()) - logits[behind % lm.DIGIT]
            n += 1
    return total / n


def test_gradients_are_those_of_the_plain_loss(monkeypatch):
    # Several chunks and blocks, cut inside runs.
    monkeypatch.setattr(lm, "CHUNK", 3)
    monkeypatch.setattr(lm, "BLOCK", 37)
    rng = np.random.default_rng(5)
    w = lm.new_weights(rng)
    for level in range(lm.LEVELS):
        w[f"out{level}"] = rng.normal(0, 0.3, w[f"out{level}"].shape).astype(np.float32)
    biases = lm.digit_biases(rng.random(lm.IDS) * 9)
    texts = [rng.integers(0, 90, n).astype(np.int16) for n in (1, 5, 16, 17, 70)]
    inputs, targets, _ = lm.windows(texts)
    g = lm.gradients(w, lm.outputs(w, biases), inputs, targets)
    exact = {k: v.astype(float) for k, v in w.items()}
    for name, found in g.items():
        at, rows = found if isinstance(found, tuple) else (np.arange(len(w[name])), found)
        assert rows.shape[1:] == w[name].shape[1:]
        for k in rng.integers(0, len(at), 4):
            if at[k] < 0:
                assert not rows[k].any()
                continue
            where = tuple(rng.integers(0, n) for n in rows.shape[1:])
            entry, sides = (at[k], *where), []
            for step in (1e-5, -1e-5):
                exact[name][entry] += step
                sides.append(plain_loss(exact, biases, inputs, targets))
                exact[name][entry] -= step
            assert abs(rows[(k, *where)] - (sides[0] - sides[1]) / 2e-5) < 1e-5, name


def test_a_learner_leaves_the_given_weights_and_biases():
    w = lm.new_weights(np.random.default_rng(1))
    before = {k: v.copy() for k, v in w.items()}
    biases = lm.digit_biases(np.arange(lm.IDS)[::-1].astype(float))
    learner = lm.Learner({k: v.copy() for k, v in w.items()}, biases, 0.01)
    inputs, targets, _ = lm.windows([np.arange(40, dtype=np.int16)])
    learner.learn(inputs, targets, 0.0)
    assert all(np.array_equal(w[k], before[k]) for k in w)
    assert all(np.array_equal(out[:, lm.WIDTH], b) for out, b in zip(learner.out, biases))
    assert all(np.shares_memory(learner.w[f"out{k}"], learner.out[k]) for k in range(lm.LEVELS))
    assert not np.array_equal(learner.w["out0"], w["out0"])


def test_ids_do_not_depend_on_what_a_worker_still_remembers(monkeypatch):
    monkeypatch.setattr(lm, "MET_WORDS", 4)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder = lm.Encoder(PIECES)
    batches = ["one two three", "", "four five", "one six  seven eight", "two ▁ one", "one"]
    for text in batches:
        words = lm.lower_words(text)
        expected = [k for word in words for k in model.encode(word.decode())] + [lm.END_ID]
        assert encoder([words])[0].tolist() == expected
    assert encoder.words.generation > 1


def test_frequent_words_keep_their_counts_when_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(lm, "MET_WORDS", 2)
    words = lm.Encoder(PIECES).words
    logs = lm.WordLogs(words, {b"a": 9, b"": 99})
    for text in (["a b a"], ["c", "a"], ["d e f a", ""], ["a"]):
        met, n_words = lm.ended_words(text)
        assert n_words.tolist() == [len(t.split()) + 1 for t in text]
        expected = [{b"a": 1.0, b"": 2.0}.get(w, np.nan) for w in met]
        np.testing.assert_allclose(logs(words.met(met)), expected)
