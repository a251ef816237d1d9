"""Random runs of every shape are found; identifiers of words are not."""

from __future__ import annotations

import random
import string

import pytest

from rankloom.llm import secrets

LOWER, UPPER = string.ascii_lowercase, string.ascii_uppercase
KINDS = {"lower": (LOWER, 1, 32), "upper": (UPPER, 1, 32),
         "licence": (UPPER + string.digits, 6, 4), "letter groups": (UPPER, 6, 4),
         "lower groups": (LOWER, 5, 5), "digit groups": (string.digits, 5, 8),
         "base62": (LOWER + UPPER + string.digits, 1, 40)}


def _spans(text):
    return [s[:2] for s in secrets.inefficient_spans(
        text, secrets.encoding_of(secrets.VOCABULARY))]


@pytest.mark.parametrize("kind", KINDS)
def test_random_runs_reach_the_token_test(kind):
    letters, groups, size = KINDS[kind]
    rng = random.Random(7)
    encoding = secrets.encoding_of(secrets.VOCABULARY)
    found = low = 0
    for _ in range(300):
        run = "-".join("".join(rng.choice(letters) for _ in range(size)) for _ in range(groups))
        low += len(run) / len(encoding.encode_ordinary(run)) < secrets.MAX_RATIO
        found += _spans(f"use {run} here") == [(4, 4 + len(run))]
    assert low >= 50 and found >= 0.99 * low


@pytest.mark.parametrize("run", [
    "INTERNATIONALIZATION_SETTINGS", "MAX_NUMBER_OF_RETRIES_2024", "parseHTTPResponseBody2Json",
    "of_to_in_the_and_for_with", "user/local/share/licenses", "--------------------",
    "=-=-=-=-=-=-=-=-=-=-=-=-", "benutzerverwaltungseinstellungen",
    "AUTHENTICATION-REQUIRED-AGAIN", "release-notes-2024-01-15-final"])
def test_identifiers_of_words_stay(run):
    assert _spans(f"see {run} here") == []


def test_long_runs_are_linear():
    assert _spans("a1" * 50_000 + "!") is not None


def _hex_run(size):
    """A random run of hex digits that the vocabulary cannot compress (92 % of 32 digits)."""
    rng, encoding = random.Random(size), secrets.encoding_of(secrets.VOCABULARY)
    while True:
        run = "".join(rng.choice("0123456789abcdef") for _ in range(size))
        if len(run) < secrets.MAX_RATIO * len(encoding.encode_ordinary(run)):
            return run


HEX_RUNS = {n: _hex_run(n) for n in (32, 40, 64)}


@pytest.mark.parametrize("size", HEX_RUNS)
@pytest.mark.parametrize("front", ["md5: ", "SHA-256 (file.iso) = ", "commit ", "sha1sum=",
                                   "key checksum ", "file ", "token\n"])
def test_digests_are_left_out(front, size):
    assert _spans(f"the {front}{HEX_RUNS[size]} here") == []


@pytest.mark.parametrize("size", HEX_RUNS)
@pytest.mark.parametrize("front", ["key ", "api_key: ", "hash of the token: ", "Bearer "])
def test_digest_shaped_secrets_are_found(front, size):
    run = HEX_RUNS[size]
    assert _spans(f"{front}{run} here") == [(len(front), len(front) + size)]


def test_planted_keys_are_found_by_the_scan(spark):
    """Base64, base58, mixed and hex keys among words, links and identifiers."""
    rng = random.Random(11)
    digits = string.digits
    base58 = [c for c in LOWER + UPPER + digits if c not in "0OIl"]
    alphabets = [LOWER + UPPER + digits + "+/", base58, UPPER + digits + "-", "0123456789abcdef"]
    clean = ["see https://example.org/some/long/path/to/readme for more",
             "def compute_monthly_average_value(self, input_values_list)",
             "d41d8cd9-8f00-3204-a980-0998ecf8427e is the md5 " + HEX_RUNS[32], None, ""]
    rows, planted = [], {}
    for i in range(400):
        if i % 2:
            key = "".join(rng.choice(alphabets[i // 2 % 4]) for _ in range(32))
            planted[i] = (9, 9 + len(key))
            rows.append((i, f"my token {key} then"))
        else:
            rows.append((i, clean[i // 2 % len(clean)]))
    found = {r.doc_id: [(s.start, s.end) for s in r.found if s.kind == "random"]
             for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))
             .collect()}
    hit = sum(found[i] == [span] for i, span in planted.items())
    false = [i for i in found if i not in planted and found[i]]
    assert hit >= 0.95 * len(planted) and false == []
