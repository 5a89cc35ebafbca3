"""Secret scans: rules, and a character convolutional network over every candidate and its context.

The rules' findings always stay. Every candidate, with the characters around it, is scored by the network: runs of key
characters with digits and letters or of mixed case, their parts between slashes and equals signs, what rules leave over
of them, passwords in addresses and behind words that announce one. What scores above a threshold that keeps a stated
recall on labelled findings is added.
"""

from __future__ import annotations

import base64
import random
import re
import string
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, short_batches

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.~-]{8,}")
_PART = re.compile(rb"[A-Za-z0-9+_.~-]{8,}")
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")
_MIXED = re.compile(rb"[a-z0-9+/][A-Z].*[a-z0-9+/][A-Z].*[A-Z][a-z0-9+/]")
_IN_ADDRESS = re.compile(rb"://[^\s/:@]{1,64}:([^\s/@]{4,256})@")
_SAID = re.compile(rb"\b(?:pass(?:word|phrase|code|wd)?|pwd|pin|passwort|kennwort|mot de passe|contrase(?:n|\xc3\xb1)a|credentials?)\b[^\n\r:=]{0,24}?(?:\b(?:is|was|ist|lautet|est|es)\b|[:=])\s*[\"'`]?([^\s\"'`]{6,256})", re.I)
_FLAG = re.compile(rb"(?:\s-[pa]\s?|\s--?pass(?:word|wd|phrase)?[ =])[\"']?([^\s\"']{6,256})", re.I)
_SAID_WORDS = (b"pass", b"pwd", b"pin", b"kennwort", b"contrase", b"credential")
KINDS = ("assign", "access", "hex", "model")

#: The network's window: characters before a candidate, its first and last ones, and characters behind it.
BEFORE, HEAD, TAIL, AFTER = 28, 28, 8, 8
WIDTH = BEFORE + HEAD + TAIL + AFTER
#: Share of labelled secrets that the threshold keeps.
RECALL = 0.98
#: A score that always counts: the threshold is no higher.
CERTAIN = 0.9
#: Labelled findings that are made when none are given.
FINDINGS = 20_000
MASK = "[SECRET]"


def rule_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings, in bytes: leftmost non-overlapping matches of each rule, of which
    those that are too short are dropped."""
    out = []
    low = data.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(data)]


def _likely(token: bytes) -> bool:
    return bool(_LETTER.search(token) and _DIGIT.search(token)) or (len(token) >= 20 and bool(_MIXED.search(token)))


def candidates(data: bytes, rules: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, bool]]:
    """(start, end, whether it has parts of its own) of the candidates, in order. A run that a rule's finding touches gives
    what it leaves over; a password that is announced counts as a whole if a finding doesn't hold all of it, and if it
    isn't a plain word."""
    taken = sorted((s, e) for s, _, e in rules)
    found: dict[tuple[int, int], bool] = {}

    def free(s: int, e: int):
        for a, b in taken:
            if b <= s or a >= e:
                continue
            if a > s:
                yield s, a
            s = max(s, b)
        if s < e:
            yield s, e

    for m in CANDIDATE.finditer(data):
        for s, e in free(*m.span()) if taken else (m.span(),):
            token = data[s:e]
            if e - s < 8 or not _likely(token):
                continue
            parts = [x.span() for x in _PART.finditer(token)] if b"/" in token or b"=" in token.rstrip(b"=") else []
            parts = [(s + a, s + b) for a, b in parts if b - a < e - s and _likely(token[a:b])]
            found[s, e] = bool(parts)
            for part in parts:
                found.setdefault(part, False)
    low = data.lower()
    for rule, words in ((_IN_ADDRESS, (b"://",)), (_SAID, _SAID_WORDS), (_FLAG, (b" -p", b" -a", b"-pass"))):
        for m in rule.finditer(data) if any(w in low for w in words) else ():
            s, e = m.span(1)
            e = s + len(data[s:e].rstrip(b".,;!?)]}>"))
            word = data[s:e].decode("utf-8", "replace")
            if e - s >= 4 and not (word.isalpha() and word[1:].islower()) and list(free(s, e)):
                found.setdefault((s, e), False)
    return [(s, e, has) for (s, e), has in sorted(found.items())]


def window(data: bytes, start: int, end: int, body: bytes) -> bytes:
    """What the network sees: characters before a candidate, characters of it, characters behind; 0 where there are none."""
    return b"".join((data[max(0, start - BEFORE) : start].rjust(BEFORE, b"\0"), body[:HEAD].ljust(HEAD, b"\0"), body[HEAD:][-TAIL:].ljust(TAIL, b"\0"), data[end : end + AFTER].ljust(AFTER, b"\0")))


def windows(data: bytes, start: int, end: int, whole: bool) -> list[bytes]:
    """All windows of a candidate: of a long one each stretch of it is seen, each in the candidate's context; of a run
    whose parts are candidates themselves (not whole) only its head and its tail."""
    body, step = data[start:end], HEAD + TAIL
    out = [window(data, start, end, body)]
    if whole and len(body) > step:
        out += [window(data, start, end, body[a : a + step]) for a in range(HEAD, len(body) - TAIL, HEAD)]
    return out


# ---- the network -----------------------------------------------------------------------------------------------------

_CLASS = np.full(256, 1, np.int64)
_CLASS[0] = 0
_CLASS[32:127] = np.arange(2, 97)
_CLASS[9:14] = 2
_SIZE, _EMBED, _FILTERS, _SPAN = 97, 10, 48, 5


@dataclass
class Network:
    """Embedding, one convolution, the largest activation in the context and in the candidate, a logistic output whose
    slope and offset are calibrated on findings that weren't trained on."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    recall: float = field(default=0.0)

    def _forward(self, x: np.ndarray):
        w = self.weights
        e = w["embed"][_CLASS[x]]
        cols = np.lib.stride_tricks.sliding_window_view(e, _SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - _SPAN + 1, _SPAN * _EMBED)
        a = np.maximum(cols @ w["conv"] + w["bias"], 0)
        inner = slice(BEFORE - 2, BEFORE + HEAD + TAIL - 2)
        outer = np.concatenate([a[:, : BEFORE - 2], a[:, BEFORE + HEAD + TAIL - 2 :]], axis=1)
        h = np.concatenate([outer.max(axis=1), a[:, inner].max(axis=1), a[:, inner].mean(axis=1)], axis=1)
        return e, cols, a, h, h @ w["out"] + w["last"]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for i in range(0, len(x), 512):
            out.append(1 / (1 + np.exp(-np.clip(self.slope * self._forward(x[i : i + 512])[-1] + self.offset, -30, 30))))
        return np.concatenate(out)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        e, cols, a, h, z = self._forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) / len(x)
        dh = dz[:, None] * w["out"]
        da = np.zeros_like(a)
        rows, filters = np.arange(len(x))[:, None], np.arange(_FILTERS)[None, :]
        lo, hi = BEFORE - 2, BEFORE + HEAD + TAIL - 2
        at = np.concatenate([a[:, :lo], a[:, hi:]], axis=1).argmax(axis=1)
        da[rows, np.where(at < lo, at, at + hi - lo), filters] += dh[:, :_FILTERS]
        da[rows, lo + a[:, lo:hi].argmax(axis=1), filters] += dh[:, _FILTERS : 2 * _FILTERS]
        da[:, lo:hi] += dh[:, None, 2 * _FILTERS :] / (hi - lo)
        da *= a > 0
        dcols = (da @ w["conv"].T).reshape(len(x), WIDTH - _SPAN + 1, _SPAN, _EMBED)
        de = np.zeros_like(e)
        for j in range(_SPAN):
            de[:, j : j + WIDTH - _SPAN + 1] += dcols[:, :, j]
        hot = np.zeros((_SIZE, x.size), w["embed"].dtype)
        hot[_CLASS[x].ravel(), np.arange(x.size)] = 1
        embed = hot @ de.reshape(-1, _EMBED)
        return {"embed": embed, "conv": np.einsum("npi,npf->if", cols, da, optimize=True), "bias": da.sum(axis=(0, 1)), "out": h.T @ dz, "last": dz.sum(keepdims=True)}


def train(x: np.ndarray, y: np.ndarray, epochs: int = 10, recall: float = RECALL, seed: int = 42, kind=np.float32) -> Network:
    """A network for windows x with labels y (1: secret). A quarter of them calibrates the scores and sets the threshold:
    the largest that keeps the recall."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, rest = order[: len(x) // 4], order[len(x) // 4 :]
    shape = {"embed": (_SIZE, _EMBED), "conv": (_SPAN * _EMBED, _FILTERS), "bias": (_FILTERS,), "out": (3 * _FILTERS,), "last": (1,)}
    net = Network({k: (rng.normal(size=s) * (0.0 if k in ("bias", "last") else 0.15)).astype(kind) for k, s in shape.items()})
    first = {k: np.zeros(s, kind) for k, s in shape.items()}
    second = {k: np.zeros(s, kind) for k, s in shape.items()}
    step, y = 0, y.astype(kind)
    for _ in range(epochs):
        rng.shuffle(rest)
        for i in range(0, len(rest), 64):
            step += 1
            for k, g in net.gradients(x[rest[i : i + 64]], y[rest[i : i + 64]]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    z, t = np.concatenate([net._forward(x[held[i : i + 512]])[-1] for i in range(0, len(held), 512)]), y[held]
    for _ in range(300):  # slope and offset of the logistic that fits the held-out labels
        p = 1 / (1 + np.exp(-np.clip(net.slope * z + net.offset, -30, 30)))
        net.slope -= 0.3 * float(((p - t) * z).mean() / max(1.0, (z * z).mean() ** 0.5))
        net.offset -= 0.3 * float((p - t).mean())
    scores = net.score(x[held])
    positive = np.sort(scores[t == 1])
    keeps = positive[int((1 - recall) * len(positive))] if len(positive) else 0.5
    net.threshold = float(min(keeps, CERTAIN))
    net.recall = float((positive >= net.threshold).mean()) if len(positive) else 0.0
    return net


# ---- labelled findings -----------------------------------------------------------------------------------------------

_ALNUM, _UPPER, _HEX = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
#: Prefixes of keys, what follows, and how many characters of it. Fixed values.
_KEYS = (
    ("ghp_", _ALNUM, 36, 36), ("gho_", _ALNUM, 36, 36), ("github_pat_", _ALNUM + "_", 60, 82), ("glpat-", _ALNUM + "_-", 20, 20), ("xoxb-", string.digits + "-" + _ALNUM, 40, 56), ("xoxp-", string.digits + "-" + _ALNUM, 40, 60), ("sk_live_", _ALNUM, 24, 34), ("rk_live_", _ALNUM, 24, 34), ("whsec_", _ALNUM, 32, 32),
    ("sk-", _ALNUM, 32, 48), ("AIza", _ALNUM + "_-", 35, 35), ("ya29.", _ALNUM + "_-", 40, 80), ("SG.", _ALNUM + "_-.", 60, 66), ("npm_", _ALNUM, 36, 36), ("pypi-AgEI", _ALNUM + "_-", 50, 90), ("dop_v1_", _HEX, 40, 64), ("shpat_", _HEX, 32, 32), ("hf_", _ALNUM, 34, 34), ("SK", _HEX, 32, 32), ("key-", _HEX, 32, 32),
    ("EAAC", _ALNUM, 40, 90), ("AKIA", _UPPER, 16, 16), ("ASIA", _UPPER, 16, 16), ("", _ALNUM + "+/", 40, 40), ("", _ALNUM, 20, 48), ("", _ALNUM + "_-", 24, 64), ("", _HEX, 32, 64), ("", _ALNUM + "!#$%^&*", 10, 24), ("AA", _ALNUM + "_-", 33, 33), ("hvs.", _ALNUM, 24, 40), ("dckr_pat_", _ALNUM + "_-", 27, 27),
)
#: Names that stand before secrets, and how; {n} is the name, {s} the secret.
_NAMES = "api_key api-key apikey token auth_token access_token secret secret_key client_secret private_key signing_key encryption_key credential webhook_secret account_key license_key bot_token deploy_key session_secret master_key shared_secret AccessKey SecretKey".split()
_SET = ('{n} = "{s}"', "{n}={s}", "{n}: {s}", '"{n}": "{s}"', "'{n}': '{s}',", "export {n}={s}", "--{n} {s}", "--{n}={s} --verbose", "{n} => '{s}'", "<{n}>{s}</{n}>", "set {n} {s}", "ENV {n} {s}", "{n} {s}", "my {n} is {s} please", "use {s} as the {n}", "the {n} was rotated to {s} today", "Authorization: Bearer {s}", "Authorization: Basic {s}", 'curl -H "X-Api-Key: {s}"', "x-auth-token: {s}", "//registry.example.org/:_authToken={s}", "https://api.example.com/v1/items?key={s}", "https://hooks.{u}.example/services/T{k}/B{k}/{s}", "https://{u}.example.com/{u}/{s}", "https://{u}.example.org/{u}/{s}/{u}.html", "https://oauth2:{s}@{u}.example.com/{u}.git", "https://{s}@{u}.example.net/{u}", "the bot is 4729103856:{s} now", "{u}={s} {u}", "{s}", "leaked: {s}", "key {s}")
_PASSWORDS = (
    "postgres://{u}:{s}@{h}/main", "https://{u}:{s}@{h}/{u}.git", "redis://:{s}@{h}/0", "mongodb+srv://{u}:{s}@{h}/test", "{u}://{u}:{s}@{h}", "git clone https://{u}:{s}@{h}/{u}/{u}", "amqp://{u}:{s}@{h}/%2f", "ftp://{u}:{s}@{h}", "mysql://root:{s}@{h}/{u}", "proxy=http://{u}:{s}@{h}",
    "password is {s}", "my password is {s}, don't", "My password was {s} until today", "the password of {u} was {s} and", "passphrase: {s}", "passphrase is {s}", "the passcode is '{s}' ok", "the {u} password was {s} last {u}", "{u} password: {s}", "Das Passwort lautet {s}", "Passwort ist {s} und", "Kennwort: {s}", "Le mot de passe est {s} merci", "La contraseña es {s}", "pwd={s}", "pwd: {s}", "password {u} is {s}",
    "Server={h};User={u};Password={s};", "User Id={u};Pwd={s};", "sshpass -p {s} ssh {u}@{h}", "sshpass -p '{s}' scp", "mysql -u {u} -p{s}", "redis-cli -a {s} ping", "--password {s}", "--password={s} {u}", "login {u} / {s}", "credentials: {s}", "{u.upper}_PASSWORD={s}", "PASSWORD={s} {u}",
)


def _maker(rng: random.Random):
    pick = lambda alphabet, a, b=0: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b or a)))
    parts = "th er on an re tion ing ent sch ung eau ment ci ado que ly ble ver con pro der la los sur net web data user main test he nd le leur ein heit lich tz elle oi vi ga ñ é è ç ê ä ü ß ó".split()
    plainly = [x for x in parts if x.isascii()]
    word = lambda a=1, b=4: "".join(rng.choice(plainly) for _ in range(rng.randint(a, b)))
    prose = lambda a, b: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) + rng.choice(("", "", "", ".", ",")) for _ in range(rng.randint(a, b)))
    number = lambda a, b: str(rng.randint(a, b))
    hexa = lambda n: pick(_HEX, n)
    uuid_ = lambda: "-".join(hexa(k) for k in (8, 4, 4, 4, 12))
    camel = lambda: "".join(word(1, 2).title() for _ in range(rng.randint(2, 5)))
    b64 = lambda a, b: base64.b64encode(rng.randbytes(rng.randint(a, b))).decode()

    def secret() -> tuple[str, str, str]:
        kind = rng.random()
        if kind < 0.54:
            lead, alphabet, a, b = rng.choice(_KEYS)
            key, form = lead + pick(alphabet, a, b), rng.choice(_SET)
        elif kind < 0.59:
            key, form = f"eyJ{pick(_ALNUM, 17, 33)}.eyJ{pick(_ALNUM, 30, 90)}.{pick(_ALNUM + '_-', 30, 43)}", rng.choice(("Authorization: Bearer {s}", "jwt={s}", "token: {s}", "{s}", 'id_token": "{s}"'))
        elif kind < 0.65:
            key, form = b64(24, 64), rng.choice((*_SET, "AccountKey={s};EndpointSuffix=core", "SharedAccessKey={s}", '"auth": "{s}"', "-----BEGIN PRIVATE KEY-----\n{s}"))
        elif kind < 0.71:
            key, form = pick(_ALNUM + "+/", 64), rng.choice(("-----BEGIN RSA PRIVATE KEY-----\n{s}", "\n{s}\n", "MII\n{s}\n" + pick(_ALNUM + "+/", 64)))
        else:
            key = rng.choice((lambda: word(1, 2).title() + pick(string.digits, 2, 4) + rng.choice("!#$%&*"), lambda: pick(_ALNUM + "!#$%*", 8, 16), lambda: word() + rng.choice("-_.") + word() + pick(string.digits, 1, 3), lambda: word(1, 2).replace("e", "3").replace("a", "4") + rng.choice("!$") + number(1, 99), lambda: f"{word(1, 2)}{number(0, 99)}{rng.choice('!#')}{word(1, 2).title()}", lambda: f"{word(1, 2)}-{word(1, 2)}-{number(1, 99)}-{word(1, 2).title()}", lambda: word(2, 3).replace("o", "0").replace("e", "3") + "-" + word(2, 3), lambda: f"{word(2, 3)}{number(10, 9999)}", lambda: f"{word(1, 2).title()}{number(1, 99)}{word(1, 3).title()}{rng.choice('!#.-')}{number(1, 99)}"))()
            form = rng.choice(_PASSWORDS)
            host = rng.choice((lambda: f"{word()}.example.{rng.choice(('com', 'org', 'net'))}", lambda: f"10.{number(0, 9)}.0.{number(1, 99)}", lambda: f"{word()}:{number(1000, 9999)}", lambda: f"{word()}.internal:{number(1000, 9999)}", lambda: "localhost", lambda: word()))()
            form = form.replace("{h}", host).replace("{u.upper}", word(1, 2).upper())
        name = rng.choice(_NAMES)
        name = rng.choice((name, name.upper(), name.replace("_", "-"), f"{word(1, 2)}_{name}".upper(), name.replace("_", " ")))
        while "{u}" in form or "{k}" in form:
            form = form.replace("{u}", word(1, 2), 1).replace("{k}", pick(_UPPER, 8), 1)
        lead, _, tail = form.replace("{n}", name).partition("{s}")
        return lead, key, tail

    plain = (
        lambda: (rng.choice(("", "see ", "class ")), camel() + number(1, 9), ""), lambda: ("", f"{word(2, 5)}.{number(10, 99)}", f"@mail{number(0, 9)}.example.com"), lambda: (f"{word()}.{number(10, 99)}@", f"mail{number(0, 99)}.example.{rng.choice(('com', 'org', 'net'))}", ""), lambda: ("", f"{word()}_{word()}_{word()}_{number(1, 99)}", ""),
        lambda: (rng.choice(("see https:", "http:", "from https:")), f"//www.{word(2, 4)}{number(1, 9)}.org/{word()}/{word()}-{number(1, 9999)}.html", ""), lambda: ("", f"https-{word()}-{number(2000, 2030)}-{word()}-{word()}", ""), lambda: (rng.choice(("version ", "v", "release ", "")), f"v{number(0, 20)}.{number(0, 30)}.{number(0, 99)}-{rng.choice(('rc', 'beta', 'alpha'))}.{number(1, 9)}", ""),
        lambda: (rng.choice(("request id ", "uuid: ", "id=", "trace ", "session ", "")), uuid_(), ""), lambda: (rng.choice(("commit ", "at revision ", "git checkout ", "sha1 ", "see ")), hexa(rng.choice((8, 10, 12, 16, 20))), ""), lambda: ('"integrity": "', "sha512-" + b64(64, 64), '"'), lambda: ("sha256:", hexa(rng.randint(12, 20)), ""),
        lambda: (rng.choice(("src=\"data:image/png;base64,", "url(data:font/woff2;base64,")), b64(40, 90), '"'), lambda: (rng.choice(("on ", "at ", "")), f"20{number(10, 39)}-{number(10, 12)}-{number(10, 28)}T{number(10, 23)}.{number(10, 59)}.{number(10, 59)}Z", ""), lambda: ("", f"20{number(10, 39)}{number(10, 12)}{number(10, 28)}T{number(100000, 235959)}Z", ""),
        lambda: (rng.choice(("file ", "open ", "in ")), f"/usr/{word()}/{word()}{number(1, 9)}.{number(0, 9)}/{word()}_{number(1, 99)}.txt", ""), lambda: ("", f"IMG_{number(1000, 9999)}_{word()}.jpg", ""), lambda: (rng.choice(("pod ", "host ", "node ", "container ")), f"{word()}-{hexa(9)}-{pick(string.ascii_lowercase + string.digits, 5)}", ""), lambda: ("", f"{word()}{number(1, 999)}.{word()}.internal", ""),
        lambda: (rng.choice(("order ", "invoice ", "ticket ", "part no ", "ISBN ")), f"{pick(string.ascii_uppercase, 2, 4)}-{number(1000, 99999)}-{number(10, 999)}", ""), lambda: ("doi ", f"10.{number(1000, 9999)}/{word()}.{number(2000, 2030)}.{number(10, 9999)}", ""), lambda: ("mac ", "-".join(hexa(2) for _ in range(6)), ""), lambda: ("", f"0x{hexa(rng.choice((8, 12, 16)))}", ""),
        lambda: ("", f"{word().upper()}_{word().upper()}_{number(1, 99)}", ""), lambda: ("#", f"{word()}{word()}{number(2000, 2030)}", ""), lambda: ("", f"{number(1, 99)}-{word()}-{word()}", ""), lambda: ("<div class=\"", f"{word()}-{number(1, 12)}-{word()}", '"'), lambda: ("", camel() + camel() + camel(), "()"), lambda: ("import ", ".".join((word(), word(), camel(), "v" + number(1, 9))), ""),
        lambda: ("the password is ", word(2, 4), f" {word()} {word()}"), lambda: ("reset your password: ", word(3, 5), f" {word()}"), lambda: ("https://", f"{word()}:{number(1000, 9999)}", f"/{word()}@{word()}"), lambda: ("utm_source=", f"{word()}_{number(1, 99)}&utm_id={number(100, 999)}", ""), lambda: ("", f"{word(2, 4)}.{word(2, 3)}{number(1, 99)}--{word()}", ""), lambda: ("", "".join(rng.choice((str.upper, str.lower))(word(1, 1)) for _ in range(9)), ""),
        lambda: ("tel ", f"+{number(10, 99)}-{number(100, 999)}-{number(1000, 9999)}-ext{number(1, 9)}", ""), lambda: ("model ", f"{pick(string.ascii_uppercase, 2, 3)}{number(100, 9999)}{pick(string.ascii_uppercase, 1, 2)}-{number(1, 99)}", ""), lambda: ("", f"{number(1, 9)}st{word(2, 3)}", ""), lambda: ("token ", f"{word(2, 3)}{number(1, 9)}", f" of {word()}"), lambda: ("key ", f"{word(2, 3)}-{number(1, 9)}", ""),
        lambda: ("", f"{word(1, 5)}.{number(10, 99)}", f"@mail{number(0, 9)}.example.com {word()}"), lambda: (f"{word()} ", f"{word(1, 3)}{number(1, 99)}", f"@{word()}.{rng.choice(('com', 'org', 'net', 'de'))}"), lambda: (f"mailto:{word()}", f"{word()}{number(1, 99)}", f"@{word()}.org"), lambda: ("", "".join(rng.choice(("Http", "URL", "XML", "Json", "SQL", "Abstract", "Factory", "Bean", "Connection", "String", "Utils", word().title())) for _ in range(rng.randint(3, 6))) + rng.choice(("", number(1, 9))), " "),
        lambda: (rng.choice(("Das Passwort ist ", "Passwort: ", "Le mot de passe est ", "La contraseña es ", "the passphrase is ", "password was ", "your password is ", "pin: ", "password: ")), word(2, 4), rng.choice((", ", " ", ".")) + word()), lambda: (rng.choice(("mkdir -p ", "cp -a ", "docker run -p ", "rsync -a ")), rng.choice((f"/var/{word()}/{word()}{number(1, 9)}", f"{number(1000, 9999)}:{number(1000, 9999)}", f"{word()}/{word()}{number(1, 9)}")), ""),
        lambda: ("", f"{word()}{number(1, 99)}/{word()}{number(1, 99)}/{word()}", ""), lambda: (f"https://{word()}.example.com/{word()}/", f"T{number(10, 99)}{word()}", f"/{word()}"), lambda: ("https://hooks.example.com/services/", "T" + pick(_UPPER, 8), "/"), lambda: ("https://hooks.example.com/services/T0/", "B" + pick(_UPPER, 8), "/"), lambda: ("", string.ascii_lowercase[: rng.randint(8, 26)] + string.digits[: rng.randint(2, 10)], " alphabet"), lambda: ("", f"{word()}.{word()}{number(1950, 2030)}", f" {word()}"),
    )
    shapes = (
        lambda: "-".join(word(1, 2) for _ in range(rng.randint(1, 4))) + number(1, 3000), lambda: f"{word(1, 2)}-{number(1, 99)}-{word(1, 2)}", lambda: "_".join(word(1, 2).upper() for _ in range(rng.randint(1, 3))) + f"_{number(1, 99)}{rng.choice(('', 'S', 'MS', 'MB'))}", lambda: f"{word(1, 2)}_{word(1, 2)}{number(1, 99)}", lambda: ".".join(word(1, 2) + number(1, 99) for _ in range(rng.randint(2, 4))),
        lambda: f"{pick(string.ascii_uppercase, 2, 4)}-{pick(string.ascii_uppercase, 3, 5)}-{number(1, 9)}", lambda: f"{number(1, 9)}{pick(string.ascii_uppercase, 1, 2)}{number(100, 999)}{pick(string.ascii_uppercase, 2)}{pick(string.digits, 8, 12)}", lambda: f"0x{pick(_HEX, rng.choice((4, 8, 12, 16)))}", lambda: f"{word(1, 2)}-{word(1, 2)}-{number(1, 9)}.{rng.choice(('sh', 'py', 'md', 'log', 'csv', 'pdf'))}", lambda: f"{word(1, 2)}-{word(1, 2)}-{hexa(rng.choice((8, 9, 10)))}-{pick(string.ascii_lowercase + string.digits, 5)}",
        lambda: f"{number(1, 99)}-{word(1, 2)}-{word(1, 2)}-{number(1, 99)}", lambda: word(1, 2).title() + word(1, 2).title() + number(1, 99), lambda: f"{word(2, 3)}{number(1, 2030)}", lambda: f"v={pick(_ALNUM, 6)}{word(1, 2)}&t={number(1, 99)}s",
    )
    places = ("{x}", "the {x} of", "in {x} and", "{n} features: {x}, {y}", "{n} {x}", "see {x}", "from {x} where {y} = 1", "./{x}: not found", "{x} = 5", "{x}: {y}", "on {x} at {y}", "'{x}'", "uses {x} ({y})", "{y} was moved to {x}", "https://{y}/{x}?page=2", "- {x}", "{x} took {y}", "[{x}]")

    def unlike() -> tuple[str, str, str]:
        """A token of a usual shape anywhere, also beside the names that stand before secrets."""
        lead, _, tail = rng.choice(places).replace("{n}", rng.choice(_NAMES).replace("_", " ")).replace("{y}", rng.choice(shapes)()).partition("{x}")
        return lead, rng.choice(shapes)(), tail

    return secret, lambda: unlike() if rng.random() < 0.4 else rng.choice(plain)(), prose


def labelled_findings(n: int = FINDINGS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels made from a fixed seed: every other text holds a secret where one usually stands, the rest
    tokens that are none. Candidates of both are labelled; what overlaps a secret in part is left out."""
    rng = random.Random(seed)
    secret, plain, prose = _maker(rng)
    x, y = [], []
    for i in range(n):
        lead, token, tail = secret() if i % 2 else plain()
        head = f"{prose(0, 8)} {lead}".lstrip(" ").encode()
        body = token.encode()
        data = head + body + tail.encode() + rng.choice((b"", b" ", b".\n", b"\n", b'" ', b"; ")) + prose(0, 4).encode()
        s, e = len(head), len(head) + len(body)
        for a, b, has in candidates(data):
            both = max(0, min(b, e) - max(a, s))
            label = both >= 0.8 * (e - s) and b - a <= 1.5 * (e - s)
            if i % 2 == 0 or label or not both:
                for w in windows(data, a, b, not has):
                    x.append(w)
                    y.append(float(i % 2 and label))
    return np.frombuffer(b"".join(x), np.uint8).reshape(-1, WIDTH), np.array(y)


@lru_cache(maxsize=1)
def default_network() -> Network:
    return train(*labelled_findings())


# ---- scans -----------------------------------------------------------------------------------------------------------


def scan(texts: list[str | None], net: Network) -> list[list[tuple[str, int, int, float]]]:
    """For each text the findings (kind, start, end, score) by start, then kind; in code points, end exclusive.

    Scores are the network's, of the rules' findings too, which stay whatever they score; a long candidate has that of
    its likeliest stretch. A candidate is a finding of the kind model if it scores the threshold at least. Of those that
    overlap, parts go before the run that they are parts of, then longer ones before shorter ones.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[list] = [[] for _ in texts]
    todo: list[bytes] = []
    whose: list[tuple[int, int, int, int, bool]] = []

    def score_all() -> None:
        if not todo:
            return
        got = net.score(np.frombuffer(b"".join(todo), np.uint8).reshape(-1, WIDTH))
        first = np.flatnonzero([k == 0 or whose[k] != whose[k - 1] for k in range(len(whose))])
        for k, p in zip(first.tolist(), np.maximum.reduceat(got, first).tolist()):
            i, s, kind, e, has = whose[k]
            if kind < 3 or p >= net.threshold:
                out[i].append((s, kind, e, p, has))
        todo.clear()
        whose.clear()

    for i, data in enumerate(raw):
        rules = rule_spans(data)
        for s, kind, e, has in [*((s, k, e, True) for s, k, e in rules), *((s, 3, e, has) for s, e, has in candidates(data, rules))]:
            views = windows(data, s, e, not has)
            for a in range(0, len(views), 1 << 14):
                todo += views[a : a + (1 << 14)]
                whose += [(i, s, kind, e, has)] * len(views[a : a + (1 << 14)])
                if len(todo) >= 4096:
                    score_all()
    score_all()
    for i, found in enumerate(out):
        kept = {}
        for s, k, e, p, _ in (x for x in found if x[1] < 3):
            kept[s, k, e] = p
        free: list[tuple[int, int]] = []
        for s, k, e, p, _ in sorted((x for x in found if x[1] == 3), key=lambda x: (x[4], x[0] - x[2], x[0])):
            if (s, k, e) in kept:  # a very long candidate was scored in several goes
                kept[s, k, e] = max(p, kept[s, k, e])
            elif all(e <= a or b <= s for a, b in free):
                kept[s, k, e] = p
                free.append((s, e))
        spans = [(s, k, e, p) for (s, k, e), p in sorted(kept.items())]
        if spans and len(raw[i]) != len(texts[i]):
            points = np.concatenate([[0], np.cumsum((np.frombuffer(raw[i], np.uint8) & 0xC0) != 0x80)])
            spans = [(int(points[s]), k, int(points[e]), p) for s, k, e, p in spans]
        out[i] = [(KINDS[k], s, e, p) for s, k, e, p in spans]
    return out


_SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, keep: list[str], net: Network | None = None) -> DataFrame:
    """The columns `keep`, and behind them findings array<struct<kind, start, end, score>>, see scan(); with underscores
    behind its name where that is kept.

    A null text is empty and has none. Whole texts are scanned; rows that repeat stay; an empty table gives an empty one.
    """
    net = net or default_network()
    rows = docs.select(*keep, docs["text"].alias(free_name("_text_", *keep)))
    name = free_name("findings", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                found = scan(part.column(part.num_columns - 1).to_pylist(), net)
                made = pa.array([[dict(zip(("kind", "start", "end", "score"), x)) for x in f] for f in found], _ARROW_SPANS)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*part.schema.names[:-1], name])

    return short_batches(rows).mapInArrow(run, f"{schema}, {name} {_SPANS}")


def masked(text: str | None, found: list) -> str | None:
    """text with each stretch of overlapping findings replaced by MASK."""
    if not found:
        return text
    out, at, reach = [], 0, 0
    for _, s, e, _ in sorted(found, key=lambda x: x[1]):
        if s >= reach:
            out += [text[at:s], MASK]
        reach = max(reach, e)
        at = reach
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """docs with findings in text masked; all rows and columns stay, null texts too. An empty table gives an empty one."""
    net = net or default_network()
    i = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                texts = part.column(i).to_pylist()
                yield part.set_column(i, part.schema.field(i), pa.array([masked(t, f) for t, f in zip(texts, scan(texts, net))], part.schema.field(i).type))

    return short_batches(docs).mapInArrow(run, docs.schema)


def joined(findings: Column, kinds: tuple) -> Column:
    """kind:start:end of the findings of some kinds, comma-joined."""
    picked = F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(picked, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
