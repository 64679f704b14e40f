"""Keys and identifiers in sensitive contexts, by length and alphabet."""

import random
import string

import pytest

from searchloom.llm import secret_scan

NAMES = (
    "get set user session token handler request response provider factory access key credential service account "
    "manager connection timeout authorization server config refresh expiry password reset controller validation filter"
).split()


@pytest.mark.parametrize("length", [12, 14, 16, 19, 20, 24, 40])
@pytest.mark.parametrize("alphabet", [string.ascii_letters + string.digits, string.ascii_letters, string.ascii_lowercase])
def test_keys_are_found(length, alphabet):
    rng, found = random.Random(length), 0
    for n in range(200):
        key = "".join(rng.choice(alphabet) for _ in range(length))
        before = ("Authorization: Bearer ", "the private key is ")[n % 2]
        found += f"novel:{len(before)}:{len(before) + length}" in secret_scan.scanned(f"{before}{key} and more words")[4]
    print(length, len(alphabet), found / 200)
    assert found >= 0.97 * 200


def test_identifiers_are_left():
    rng, marked, n = random.Random(1), 0, 0
    for _ in range(600):
        words = [rng.choice(NAMES) for _ in range(rng.randint(2, 4))]
        name = rng.choice(("_".join(words), "-".join(words), words[0] + "".join(w.title() for w in words[1:])))
        if len(name) >= 12:
            n += 1
            marked += "novel" in secret_scan.scanned(f"the auth module calls {name} here")[4]
    words = ["authentication", "documentation", "responsibilities", "internationalization", "administration"]
    assert not any("novel" in secret_scan.scanned(f"private {w} follows")[4] for w in words)
    print(marked / n)
    assert marked <= 0.1 * n


OTHERS = "report invoice payment school money week market health order client server data value index table state event group member file path image video link page gateway".split()
KINDS = {
    "camel": lambda w, r: "".join(x.title() for x in w) + str(r.randint(1, 99)),
    "snake": lambda w, r: "_".join(w) + f"_{r.randint(1, 9)}",
    "version": lambda w, r: "_".join(w[:3]) + f"_v{r.randint(1, 9)}",
    "path": lambda w, r: "/srv/" + "/".join(w[:3]) + f"/part-{r.randint(0, 50):04d}",
    "year": lambda w, r: "-".join(w) + f"-{r.randint(1990, 2030)}",
    "constant": lambda w, r: "_".join(x.upper() for x in w[:3]),
}


@pytest.mark.parametrize("kind", KINDS)
def test_names_with_digits_paths_and_versions_are_left(kind):
    rng, marked, n = random.Random(4), 0, 0
    for _ in range(800):
        name = KINDS[kind]([rng.choice(NAMES + OTHERS) for _ in range(4)], rng)
        if len(name) >= 12:
            n += 1
            marked += "novel" in secret_scan.scanned(f"the token class {name} is here")[4]
    print(kind, marked / n)
    assert marked <= 0.05 * n


def test_a_key_far_behind_its_name():
    rng = random.Random(5)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(30))
    near, far = ("the private one that we keep for the machines in the other room is " + key, "private " + "word " * 30 + key)
    assert "novel" in secret_scan.scanned(near)[4] and "novel" not in secret_scan.scanned(far)[4]
