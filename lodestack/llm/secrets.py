"""Credentials written out in source, configuration and documents.

Text is cut into lexical tokens; a linear-chain conditional random field with
shape and context features labels each as outside, begin or inside of a
credential, and the Viterbi path gives the spans that are redacted, so exactly
the literal's characters change and all code around them stays.

A literal without a mixture of character classes (a plain word, a number, a few
characters) is looked at only where a credential is expected: in the place of
the value of a name or flag that means one, of a password in an address or
login, or of a command's input that is one. There the field decides by its shape, quotes and surroundings; anywhere
else it is outside. A line that holds neither decodes to nothing but outside and
is passed over without running the chain; this is exact, not a sample.
Of a phrase with blanks only the mixed words are looked at.

Labels O, B, I. The field is fitted by ``train`` on lines that
``labelled_lines`` makes (``TRAIN_LINES`` of them, a bound), and its weights
are kept in ``secret_weights.json`` beside this file. A private key in PEM form
is one token per line; the key's body goes with its first line, up to the key's end
or a line that is no part of one, however long its lines are. A text that begins within a
key and holds its end has that part redacted too; it starts no credential. A literal that
goes on in the next line is redacted there too, but counts where it starts.

Each row is one chunk and nothing is shuffled but the lines found, to drop
repeated ones.
Cases: null and empty contents have no credential and a null or empty redacted
text; repeated ids count once; extra columns are never read.
"""

from __future__ import annotations

import json
import math
import pkgutil
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.columns import pick
from lodestack.session import spread

WEIGHTS = Path(__file__).with_name("secret_weights.json")
TRAIN_LINES = 20_000
LABELS = ("O", "B", "I")
MASK = "REDACTED"

_SEP = r"\s\"'`,;()\[\]{}|\\<>"
_TOKEN = re.compile(
    rf"""(?x)
    (?P<pem>-----(?:BEGIN|END)\ [A-Z0-9\ ]+-----)
    |(?P<url>[A-Za-z][A-Za-z0-9+.\-]{{1,20}}://(?P<user>[^{_SEP}:/@]*):(?P<pw>[^{_SEP}@]+)@[^{_SEP}]*)
    |(?P<run>[^{_SEP}]+)
    """
)
_ADMIT = re.compile(
    r"(?=\S*[A-Za-z])(?=\S*\d)\S{6,}|(?=\S*[a-z])(?=\S*[A-Z])(?=\S*[^A-Za-z0-9\s])\S{8,}"
    r"|[A-Z]{5}(?:-[A-Z]{5})+(?:-[A-Z]{1,5})?|(?=[A-Za-z]*[a-z][A-Z][A-Za-z]*[a-z][A-Z])(?=[A-Za-z]*[A-Z]{2})[A-Za-z]{10,}"
)
#: Names that only say that a value follows.
_TRANSPARENT = {"default", "value", "val", "values", "string", "str", "const", "char"}
_ESCAPE = re.compile(r"x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[nrt0](?=[A-Za-z0-9+/=]{8})")
_NAME = re.compile(r"[a-z_][a-z0-9_.\-]*|[A-Z_][A-Z0-9_]*|[A-Za-z][a-z]*(?:[A-Z][a-z]+)*")
_URL = re.compile(rf"://([^{_SEP}:/@]*):([^{_SEP}@]+)@")
#: A member of a short name, as minifiers write: no literal, whatever follows it.
_MEMBER = re.compile(r"[A-Za-z_$]{1,4}(?:[?:&|!]+[A-Za-z_$]{0,4})?\.[A-Za-z_$]+(?:[!=]==?|[-+*/%]?=)?(?:[A-Za-z_$.!]*=?)?")
_NAMES_APART, _PART = re.compile(r"[-._/:=]"), re.compile(r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*[A-Z]*|[A-Z]*)")
_KEYED = re.compile(r"^(\$\{|[{<*\-]*)([A-Za-z_][\w.\-]*?)(\*\*|)(:=|=>|=|:)([^=].*)$", re.S)
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: Words of names that hold credentials, and words that make of such a name something else.
SECRET_WORDS = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "secret", "token", "apikey", "credential", "credentials", "kennwort", "passwort", "clave", "contrasena", "contraseña", "auth", "bearer", "basic", "pw", "motdepasse", "pin", "psk", "privkey"}
SECRET_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("signing", "key"), ("encryption", "key"), ("secret", "key"), ("master", "key"), ("account", "key"), ("de", "passe"), ("shared", "key"), ("service", "key"), ("hmac", "key"), ("auth", "key"), ("session", "key"), ("storage", "key")}
META_WORDS = {"hint", "name", "field", "path", "file", "url", "uri", "id", "ids", "length", "len", "min", "max", "ttl", "policy", "count", "expires", "expiry", "type", "label", "header", "hash", "hashed", "digest", "checksum", "salted", "placeholder", "prompt", "regex", "pattern", "ref", "arn", "version", "public", "pub", "reset", "env", "var", "quota", "ticket", "batch", "limit", "size", "input"}
HASH_WORDS = {"integrity", "digest", "checksum", "etag", "sha", "sha1", "sha256", "sha512", "md5", "commit", "revision", "rev", "fingerprint", "hash", "crc", "signature", "resolution", "resolved", "oid", "blob"}
ID_WORDS = {"id", "uuid", "guid", "trace", "request", "tenant", "span", "session", "user", "correlation", "run", "build"}
OPEN_WORDS = {"authorized", "public", "publickey", "icon", "image", "cert", "certificate", "logo", "data", "example", "sample", "dummy"}
#: How well-known services begin their tokens.
PREFIX = re.compile(r"^(?:AKIA|ASIA|AIza|ya29\.|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_(?:live|test)_|rk_live_|pk_live_|npm_|pypi-|SG\.|hf_|dop_v1_|shpat_|sk-|whsec_|hvs\.|dp\.[a-z]+\.)")
_LIKE_PREFIX = re.compile(r"^[a-z][a-z0-9]{1,5}(?:[-_.][a-z0-9]{1,6}){0,2}[-_.](?=[A-Za-z0-9_\-.]*[A-Z])(?=[A-Za-z0-9_\-.]*[a-z])(?=[A-Za-z0-9_\-.]*\d)[A-Za-z0-9]{16,}$")
_KINDS = [
    ("pem_private", re.compile(r"^-----BEGIN [A-Z0-9 ]*PRIVATE KEY")), ("pem_other", re.compile(r"^-----(?:BEGIN|END)")),
    ("integrity", re.compile(r"(?i)^(?:sha|md)\d+[-:=$]")), ("dataurl", re.compile(r"^(?:data:)?[a-z]+/[\w.+\-]+;?|^base64")), ("sshkey", re.compile(r"^(?:ssh-|AAAA[BCE]3)")),
    ("crypt", re.compile(r"^\$(?:2[aby]|5|6|argon2\w*|pbkdf2[\w\-]*)\$|^pbkdf2|^scrypt")), ("prefix", PREFIX), ("jwt", re.compile(r"^eyJ[\w\-]{8,}")),
    ("uuid", re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")), ("color", re.compile(r"^#[0-9a-fA-F]{3,8}$")),
    ("holder", re.compile(r"(?i)your[-_]|change[-_]?me|replace[-_]?me|x{6,}|\*{3,}|insert[-_]|example|placeholder|dummy|redacted|todo|\.\.\.|<[^>]*>|\{\{|\$\{|^\$[A-Z_(]|^%[A-Z_]+%$|^\$\(")),
    ("pointer", re.compile(r"(?i)^(?:vault|env|ref|ssm|arn|secretmanager|keyring|file|aws-sm|op):|os\.environ|getenv|process\.env|[:/][\w.\-/]*#[A-Za-z_]+$")),
    ("url", re.compile(r"^[a-z][a-z0-9+.\-]*://")), ("version", re.compile(r"^v?\d+(?:\.\d+)+[\w.\-]*$")), ("date", re.compile(r"^\d{4}-\d\d-\d\d")), ("likeprefix", _LIKE_PREFIX),
    ("groups", re.compile(r"^[A-Z0-9]{4,6}(?:-[A-Z0-9]{1,6})+$")), ("hex", re.compile(r"^[0-9a-f]{14,}$|^[0-9A-F]{16,}$")), ("hexnum", re.compile(r"(?i)^0x[0-9a-f]+$")),
    ("path", re.compile(r"^[\w.\-@]*/[\w./\-@:*{}$]*$")), ("b64", re.compile(r"^[A-Za-z0-9+/\-_]{16,}={1,2}$|^(?=.*[+/])[A-Za-z0-9+/]{16,}$")),
    ("dashwords", re.compile(r"^[a-z]+(?:-[a-z]+)+\d+$")), ("random", re.compile(r"^(?=.*[A-Z])(?=.*[a-z])(?=.*\d)[A-Za-z0-9]{10,}$")),
    ("leet", re.compile(r"^(?=.*\d)(?=.*[a-z])[a-z0-9]+_\d{2,}$|^(?=[a-z]*\d[a-z]+)[a-z0-9_]{6,}$")), ("word", re.compile(r"^[A-Za-z_][\w.]*$")),
    ("mixed", re.compile(r"^(?=.*[A-Za-z])(?=.*[^A-Za-z0-9_.\-/:])\S{6,}$")),
]


@lru_cache(1 << 16)
def name_class(name: str) -> str:
    words = [w.lower() for w in _CAMEL.findall(name)]
    if not words:
        return "none"
    pairs = set(zip(words, words[1:]))
    secret = any(w in SECRET_WORDS for w in words) or bool(pairs & SECRET_PAIRS) or "".join(words) in SECRET_WORDS
    if secret:
        last = words[-1]
        return "meta" if (last in META_WORDS or words[0] in {"max", "min", "public", "hashed", "num"}) and last not in SECRET_WORDS else "secret"
    if any(w in HASH_WORDS for w in words) or "".join(words) in HASH_WORDS:
        return "hash"
    if words[-1] in ID_WORDS or (len(words) > 1 and words[-1] == "id"):
        return "id"
    if any(w in OPEN_WORDS for w in words):
        return "open"
    return "plain"


_ENCODED = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")


def scrambled(tok: str) -> bool:
    """Encoded bytes, told from a path by how often the kind of character changes."""
    if not _ENCODED.fullmatch(tok):
        return False
    kinds = ["/" if c in "+/=" else "9" if c.isdigit() else "A" if c.isupper() else "a" for c in tok]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) >= 0.4 * len(tok)


def kind_of(tok: str) -> str:
    for kind, rx in _KINDS:
        if rx.search(tok):
            return "b64" if kind == "path" and scrambled(tok) else kind
    return "other"


class Token:
    __slots__ = ("text", "start", "end", "slot", "quoted", "gap", "after")

    def __init__(self, text: str, start: int, end: int, slot: str = "", quoted: bool = False):
        self.text, self.start, self.end, self.slot, self.quoted = text, start, end, slot, quoted
        self.gap = self.after = ""


#: Commands that read a password from a pipe, and clients whose flag -p takes one with no blank between.
_PIPED = re.compile(r"\|\s*(?:sudo\s+(?:-[a-zA-Z]+\s+){0,4}-S\b|chpasswd\b|passwd\s+--stdin\b|[^|]{0,200}--(?:password|passphrase|token)-stdin\b|[^|]{0,200}-pass(?:in)?\s+stdin\b)")
_CLIENT = re.compile(r"\b(?:mysql\w*|mariadb\w*|sshpass|mongo\w*|7z)\b")


def _reads_pipe(line: str) -> bool:
    return "|" in line and ("sudo" in line or "stdin" in line or "chpasswd" in line)


def tokens(line: str) -> list[Token]:
    """Lexical tokens with their places; slots name the part of a composite one."""
    out: list[Token] = []
    piped = {len(line[: m.start()].rstrip(" \t\"'")) for m in _PIPED.finditer(line)} if _reads_pipe(line) else set()
    client = "-p" in line and _CLIENT.search(line)
    for m in _TOKEN.finditer(line):
        quoted = m.start() > 0 and line[m.start() - 1] in "\"'`"
        if m["pem"]:
            out.append(Token(m["pem"], m.start(), m.end(), "pem"))
            continue
        if m["url"]:
            out.append(Token(m["pw"], m.start("pw"), m.end("pw"), "userinfo", quoted))
            continue
        start, text = m.start(), m["run"]
        if start and line[start - 1] == "\\" and (escape := _ESCAPE.match(text)):
            start, text = start + escape.end(), text[escape.end() :]
            if not text:
                continue
        before = out[-1].text if out else ""
        if client and start > client.end() and (text[:2] == "-p" and len(text) > 2 and not quoted and text[2] not in "-=" or before == "-p" and line[out[-1].end : start] in ("'", '"', *(" ", " '", ' "') * (client[0] == "sshpass"))):
            at = start + 2 * (text[:2] == "-p" and before != "-p")
            out.append(Token(line[at : m.end()], at, m.end(), "login", quoted))
            continue
        if m.end() in piped:
            out.append(Token(text, start, m.end(), "login", quoted))
            continue
        inner = _URL.search(text) if "://" in text else None
        if inner:
            named = _KEYED.match(text[: inner.start()] + "x")
            if named and named[5].isalnum():
                out.append(Token(named[2], start + named.start(2), start + named.end(2), "key"))
            out.append(Token(inner[2], start + inner.start(2), start + inner.end(2), "userinfo", quoted))
            continue
        if before in ("-u", "--user") and ":" in text.lstrip(":")[:-1]:  # a login, whatever its password begins with
            user, _, word = text.partition(":")
            out.append(Token(user, start, start + len(user), "user"))
            out.append(Token(word, start + len(user) + 1, m.end(), "login", quoted))
            continue
        key = _KEYED.match(text)
        if key and not text.startswith(("vault:", "env:", "arn:", "data:", "sha")) and "://" not in text[: len(key[2]) + 4]:
            at = start + key.start(2)
            flag = text.startswith("--")
            out.append(Token(key[2], at, at + len(key[2]), "flag" if flag else "key"))
            text, start, slot = key[5], start + key.start(5), "value"
        else:
            slot = "value" if out and line[out[-1].end : start].strip(" \t\"'`(\\") in ("=", ":", ":=", "||=", "+=", "=>") else ""
            bare = text.strip("{}<>*:.=")
            if re.fullmatch(r"[=:+|>*\-]+|", bare) or text in ("=", ":", ":=", "=>", "||="):
                continue
        if "${" in text or "{{" in text or text.startswith("$"):
            out.append(Token(text, start, start + len(text), slot, quoted))
        else:
            core = text
            while core and core[-1] in "}>:*" and not (core[-1] == "}" and "{" in core):
                core = core[:-1]
            lead = len(core) - len(core.lstrip("{<*"))
            core = core[lead:]
            # a key that ends in a colon or an equals sign
            if core:
                end = start + lead + len(core)
                name = core.removesuffix("=")
                opens = text.endswith(":") or (text.endswith("=") and not quoted and line[m.end() : m.end() + 1] in ("", *"\"'` ("))
                is_key = opens and len(name) < 40 and bool(_NAME.fullmatch(name.lstrip("-")))
                if core.startswith("--") and not is_key and re.fullmatch(r"--[A-Za-z][\w\-]*", core):
                    slot = "flag"
                out.append(Token(name if is_key else core, start + lead, end, "key" if is_key else slot, quoted))
    at = 0
    for t in out:
        t.gap, t.after, at = line[at : t.start], line[t.end : t.end + 2], t.end
    return out


def admissible(t: Token) -> bool:
    if t.slot == "pem":
        return t.text.startswith("-----BEGIN")
    # an address without a password in it, and the rest of one behind a placeholder, hold none
    if t.slot in ("key", "flag", "user") or (t.text[0] in "@:/" and not scrambled(t.text)) or "://" in t.text:
        return False
    if not _ADMIT.fullmatch(t.text) or _MEMBER.fullmatch(t.text):
        return False
    # names of several words, as headers and members have
    return not all(map(_PART.fullmatch, _NAMES_APART.split(t.text)))


def expected(toks: list[Token], carried: str = "none") -> list[bool]:
    """Whether each token stands where the value of a credential does."""
    out = []
    for i, t in enumerate(toks):
        if t.slot in ("userinfo", "login"):
            out.append(True)
        elif t.slot in ("key", "flag", "user", "pem") or (t.text[0] in "@:/" and not scrambled(t.text)) or "://" in t.text:
            out.append(False)
        elif i == 0:
            out.append(carried == "secret" and t.quoted)
        else:
            j = i - 1
            while j and toks[j].slot not in ("key", "flag") and toks[j].text.lower() in _TRANSPARENT:
                j -= 1
            named = t.slot == "value" or toks[j].slot == "flag" or (toks[j].slot == "key" and not t.gap.strip(" \t\"'`(\\=:>"))
            out.append(named and name_class(toks[j].text) == "secret")
    return out


def offered(toks: list[Token], carried: str = "none") -> list[bool]:
    """Whether each token may be labelled as a credential at all."""
    return [admissible(t) or e for t, e in zip(toks, expected(toks, carried))]


#: Words that stand for a value or its type, and names of credentials that often mean something else.
NO_VALUES = {"none", "null", "nil", "true", "false", "undefined", "str", "string", "bool", "boolean", "int", "number", "text", "bytes", "any", "optional", "required", "empty", "unset", "default", "value", "input", "hidden", "self", "this", "data", "char", "object", "yes", "no", "on", "off", "me", "user", "username", "disabled", "enabled"}
LOOSE_WORDS = {"token", "auth", "basic", "bearer", "pin", "pass", "credential", "credentials"}


def _plain_features(t: Token, key: Token | None) -> list[str]:
    """Features of a literal without a mixture of characters where a credential is expected."""
    x, place = t.text, t.slot if t.slot in ("userinfo", "login") else "flag" if key is not None and key.slot == "flag" else "value"
    closed = t.quoted and t.after[:1] in "\"'`" and t.after != ""
    held = "inner" if place in ("userinfo", "login") else "quoted" if closed else "cut" if t.quoted else "bare"
    tail = t.after[1:] if closed else t.after[:1]
    tail = tail.strip() or ("end" if not tail or tail in "\r" else "blank")
    shape = "digits" if x.isdigit() else "lower" if x.isalpha() and x.islower() else "capitals" if x.isalpha() and x.isupper() else "title" if x.isalpha() and x.istitle() else "letters" if x.isalpha() else "name" if re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[\w$]+)*", x) else "joined" if all(map(_PART.fullmatch, _NAMES_APART.split(x))) else "marks"
    words = [w.lower() for w in _CAMEL.findall(x)]
    says = "nothing" if x.lower() in NO_VALUES else "itself" if name_class(x) in ("secret", "meta") else "other"
    of = [w.lower() for w in _CAMEL.findall(key.text)] if key is not None else []
    loose = bool(of) and any(w in LOOSE_WORDS for w in of) and not any(w in SECRET_WORDS - LOOSE_WORDS for w in of)
    gap = t.gap.strip("\"'`(\\") or "none"
    gap = {"=": "tight", " = ": "apart", ": ": "colon", " ": "blank"}.get(gap, "other")
    size = min(len(x) // 3, 5)
    return [
        "bias", "expected", f"expected={place}|{held}|{says}", f"expected={held}|{shape}|{gap}|loose={loose}", f"expected={held}|{shape}|{place}", f"expected={held}|tail={tail}", f"expected={held}|tail={tail}|{gap}", f"expected=says={says}",
        f"expected=kind={kind_of(x)}", f"expected={held}|size={size}|{shape}", f"expected={held}|loose={loose}", f"expected=loose={loose}|{shape}|size={size}", f"expected=words={min(len(words), 4)}|{shape}|{held}",
    ]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


_ASIDE = re.compile(r"\b(?:example|e\.g|sample|dummy|fake|not real|do not use|revoked|invalid)\b")
ASIDE_REACH = 200


def features(toks: list[Token], carried: str = "none") -> list[list[str]]:
    """Shape and context features of each token. ``carried``: the class of a name at the end of the line before."""
    classes = ["none" if t.slot == "pem" or admissible(t) else name_class(t.text) for t in toks]
    ends = list(accumulate(len(t.text.lower()) + 1 for t in toks))
    asides = [bisect_right(ends, m.start()) for m in _ASIDE.finditer(" ".join(t.text.lower() for t in toks))]
    out, named = [], expected(toks, carried)
    for i, t in enumerate(toks):
        # in a line of many tokens such a word says nothing of far ones
        near = bisect_left(asides, i - ASIDE_REACH) if len(toks) > 2 * ASIDE_REACH else 0
        aside = "aside" if near < len(asides) and (len(toks) <= 2 * ASIDE_REACH or asides[near] <= i + ASIDE_REACH) else ""
        if not admissible(t):
            key = next((toks[j] for j in range(i - 1, -1, -1) if toks[j].slot in ("key", "flag")), None) if named[i] else None
            out.append([*_plain_features(t, key), *[aside] * bool(aside)] if named[i] else ["bias", "barred"])
            continue
        kind = kind_of(t.text)
        # the nearest name to the left: the key of this value, or a word of the sentence
        name = carried if i == 0 else "none"
        for j in range(i - 1, max(-1, i - 7), -1):
            if toks[j].text.lower() in _TRANSPARENT:
                continue
            if toks[j].slot in ("key", "flag"):
                name = classes[j]
                break
            if classes[j] in ("secret", "meta", "hash", "id", "open"):
                name = classes[j]
                break
        else:
            if i:
                name = "plain" if name == "none" else name
        prev = toks[i - 1].text.lower() if i else ""
        size = len(t.text)
        h = _entropy(t.text) if t.slot != "pem" else 0
        f = ["bias", f"kind={kind}", f"name={name}", f"kind={kind}|name={name}", f"slot={t.slot}", f"slot={t.slot}|kind={kind}", f"size={min(size // 6, 8)}", f"entropy={min(int(h), 5)}", f"entropy={min(int(h), 5)}|name={name}", f"quoted={t.quoted}|name={name}"]
        if prev in ("basic", "bearer", "token"):
            f.append(f"after={prev}|" + ("strong" if kind in ("b64", "jwt", "random", "hex", "groups", "mixed", "prefix", "likeprefix", "leet", "other", "word") else kind))
        if prev in ("vault", "under", "show", "pass", "path", "env"):
            f.append("after=pointer")
        if aside:
            f.append(aside)
        out.append(f)
    return out


class Field:
    """A linear-chain conditional random field over string features."""

    def __init__(self, names: list[str], unary: np.ndarray, pair: np.ndarray):
        self.index = {n: i for i, n in enumerate(names)}
        self.unary, self.pair = unary, pair

    @classmethod
    def load(cls, path: Path | None = None) -> Field:
        d = json.loads(path.read_text() if path else pkgutil.get_data(__package__, WEIGHTS.name))
        return cls(list(d["unary"]), np.array(list(d["unary"].values())), np.array(d["pair"]))

    def save(self, path: Path = WEIGHTS) -> None:
        rows = {n: [round(float(x), 3) for x in self.unary[i]] for n, i in sorted(self.index.items())}
        path.write_text(json.dumps({"labels": LABELS, "pair": np.round(self.pair, 3).tolist(), "unary": rows}, indent=0))

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        s = np.array([self.unary[[self.index[x] for x in f if x in self.index]].sum(0) for f in feats]).reshape(len(feats), 3)
        for i, f in enumerate(feats):
            if "barred" in f:
                s[i, 1:] = -1e6
        return s

    def decode(self, feats: list[list[str]]) -> list[int]:
        s = self.scores(feats)
        best, back = s[0] + np.array([0, 0, -1e6]), []
        for row in s[1:]:
            step = best[:, None] + self.pair
            back.append(step.argmax(0))
            best = step.max(0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


# --- training -------------------------------------------------------------------------------------------------------


def _word(r: random.Random) -> str:
    return "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4))) + r.choice(["", "n", "r", "s"])


def _rand(r: random.Random, n: int, chars: str) -> str:
    return "".join(r.choice(chars) for _ in range(n))


_AZ, _az, _09 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _AZ + _az + _09


def _password(r: random.Random) -> str:
    w = _word(r)
    return r.choice([
        lambda: "-".join(_word(r) for _ in range(r.randint(2, 4))) + r.choice(_09), lambda: w.capitalize() + r.choice("-_.!+") + _word(r) + r.choice("!%+#") + str(r.randint(10, 999)),
        lambda: w.replace("a", "4").replace("e", "3", 1).replace("o", "0") + "_" + str(r.randint(1000, 9999)), lambda: _rand(r, r.randint(10, 18), _ALNUM + "!%#*?_+=-"), lambda: _rand(r, r.randint(10, 16), _ALNUM), lambda: w + "_" + str(r.randint(100, 9999)),
    ])()


def _b64(r: random.Random, raw: str) -> str:
    import base64

    return base64.b64encode(raw.encode()).decode()


def _strong(r: random.Random) -> str:
    """A value that is a credential by its own form."""
    n = r.randint(20, 40)
    return r.choice([
        lambda: "AKIA" + _rand(r, 16, _AZ + _09), lambda: r.choice(["ghp_", "npm_", "sk_live_", "glpat-", "hf_", "gho_"]) + _rand(r, n, _ALNUM), lambda: f"xoxb-{r.randint(10**10, 10**11)}-{_rand(r, 24, _ALNUM)}",
        lambda: f"SG.{_rand(r, 22, _ALNUM)}.{_rand(r, 40, _ALNUM)}", lambda: "dp.st.prd." + _rand(r, n, _ALNUM), lambda: _rand(r, r.randint(2, 3), _az) + r.choice(["1.", "-live-", "-prod-", "_tok_", "2."]) + _rand(r, n, _ALNUM),
    ])()


def _secret_value(r: random.Random) -> str:
    n = r.randint(20, 40)
    return r.choice([
        lambda: _password(r), lambda: _password(r), lambda: _strong(r), lambda: _rand(r, n, _ALNUM), lambda: _rand(r, r.choice([16, 20, 32, 40, 64]), _09 + "abcdef"), lambda: "-".join(_rand(r, 5, _AZ + _09) for _ in range(r.randint(3, 5))),
        lambda: r.choice(["", "", "/"]) + _rand(r, n, _ALNUM + "+/") + "=" * r.randint(0, 2), lambda: _b64(r, _password(r)), lambda: "-".join(_rand(r, 5, _AZ + _09) for _ in range(2)) + "-" + _rand(r, 2, _AZ), lambda: _rand(r, r.randint(11, 18), _ALNUM),
    ])()


def _no_value(r: random.Random) -> str:
    """What stands in the place of a credential without being one."""
    w = _word(r)
    return r.choice([
        lambda: r.choice(["********", "xxxxxxxxxxxxxxxx", "REPLACE_ME", "changeme-placeholder", "insert-token-here", "...", "<redacted>", "EXAMPLE-KEY-DO-NOT-USE", "example123key", "your-token-123"]),
        lambda: "${" + w.upper() + "}", lambda: "{{ " + w + " }}", lambda: "$" + w.upper(), lambda: "%" + w.upper() + "%", lambda: f"<your-{w}>", lambda: f"vault:{w}/{_word(r)}#Pass{w}", lambda: f"$(pass show {w}/{w.upper()}_Key1)", lambda: f"env:{w.upper()}_V2",
        lambda: f'" + os.environ["{w.upper()}"] + "', lambda: "$2b$12$" + _rand(r, 50, _ALNUM + "./"),
    ])()


def _neutral(r: random.Random) -> tuple[str, str]:
    """A name and a value that look random but are no credential."""
    w, hexa = _word(r), _09 + "abcdef"
    uuid = "-".join(_rand(r, n, hexa) for n in (8, 4, 4, 4, 12))
    return r.choice([
        lambda: (r.choice(["integrity", "sri_hash"]), "sha512-" + _rand(r, 86, _ALNUM + "+/") + "=="), lambda: (r.choice(["etag", "commit", "revision", "GIT_SHA", "git_commit", "blob_oid"]), _rand(r, 40, hexa)), lambda: (r.choice(["sha256", "digest", "checksum", "fingerprint", "password_hash", "md5"]), _rand(r, r.choice([32, 64]), hexa)),
        lambda: (r.choice(["request_id", "tenant_id", "trace", "keyId", "span_id", "user_id"]), uuid), lambda: (r.choice(["authorized", "publicKey", "deploy_public_key"]), "ssh-ed25519 " + _rand(r, 68, _ALNUM + "+/") + " " + w), lambda: ("icon", "data:image/png;base64," + _rand(r, 90, _ALNUM + "+/")),
        lambda: (w, w + str(r.randint(1, 99))), lambda: (w, f"{w}/registry:{r.randint(1, 90)}.{r.randint(1, 90)}"), lambda: (f"{w}_color", "#" + _rand(r, 6, hexa)), lambda: (r.choice(["passwordField", "password_hint", "secret_name", "token_type", "max_token_quota"]), r.choice(["#pw-input2", f"{w}-password1", "bearer", "must be 12 characters or longer", "6067"])),
        lambda: (f"{w}{w.capitalize()}", _word(r).capitalize() + _word(r).capitalize() + str(r.randint(1, 9))), lambda: ("version", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}-rc1"), lambda: ("updated", f"2025-0{r.randint(1, 9)}-1{r.randint(0, 9)}T0{r.randint(0, 9)}:12:33Z"), lambda: (w, f"https://{w}.invalid/{_rand(r, 12, _ALNUM)}"),
        lambda: (r.choice([w, "table", "chunk", f"{w}_{_word(r)}"]), _rand(r, r.randint(16, 76), _ALNUM + "+/")), lambda: (r.choice([w, f"{w}_{_word(r)}", f"{w}{w.capitalize()}"]), _rand(r, r.randint(12, 60), _ALNUM)), lambda: (r.choice([w, f"{w}_{_word(r)}"]), _rand(r, r.choice([16, 32, 40, 64]), hexa)), lambda: (w, f"0x{_rand(r, 8, hexa)}"), lambda: ("font", f"{w}-Bold.woff2"), lambda: (r.choice(["DATABASE_URL", "dsn"]), f"postgresql://{w}{r.choice(['', ':***', ':{pw}', ':${DB_PASS}', ':<password>'])}@{_word(r)}.invalid:5432/{w}"),
    ])()


_NAMES = ["password", "passwd", "pwd", "passphrase", "secret", "api_key", "apiKey", "API_KEY", "accessKey", "ACCESS_TOKEN", "auth_token", "clientSecret", "CLIENT_SECRET", "db_password", "adminPassword", "WEBHOOK_SECRET", "signing_key", "encryption_key", "private_token", "login_secret", "session_salt_secret", "SMTP_PASS", "REDIS_AUTH", "mot_de_passe", "Kennwort", "db-pass", "bearerToken", "masterKey", "contrasena", "refresh_token"]
_PLAIN = ["k", "value", "cfg", "remote", "hook", "deploy", "conn", "publisher", "telemetry", "upstream", "target", "endpoint", "broker_url", "x", "opts"]
_FORMS = [
    '{k} = "{v}"', "{k} = '{v}'", "{k}: {v}", '{k}: "{v}",', "{k}={v}", "export {k}={v}", 'export {k}="{v}"', 'const {k} = "{v}";', "let {k}='{v}'", 'const {k} = "{v}" +', 'var {k} string = "{v}"', "{k} := `{v}`", '#define {k} "{v}"', 'static const char {k}[] = "{v}";',
    'private static final String {k} = "{v}";', 'props.setProperty("{k}", "{v}");', '@Value("${{{k}:{v}}}")', 'headers.set("{k}", "{v}");', 'os.environ.setdefault("{k}", "{v}")', 'parser.add_argument("--{k}", default="{v}")', "process.env.{k} ||= `{v}`;", 'self.{k}: str = "{v}"', '"{k}": "{v}",', "SET app.{k} = '{v}';",
    "INSERT INTO settings (name, val) VALUES ('{k}', '{v}');", "- `{k}` is `{v}` on every box", "set **{k}** to `{v}`", "| {k} | {v} |", '  --{k} "{v}" \\', "  --{k}={v}", "// run: tool login --user bob --{k}={v}", "- {k}={v}", 'return {{{k}:"{v}"}}', "body: '{{\\\"user\\\": \\\"bob\\\", \\\"{k}\\\": \\\"{v}\\\"}}',", '{k} = ("{v}"',
    "# the {k} was {v} before the move", "<{k}>{v}</{k}>", 'connect("host", {k}="{v}", port=5432)', "{k} is {v}", '{k} => "{v}",', "; {k} = {v}", "the {k} is `{v}`, please keep it",
]


def _plain_value(r: random.Random) -> str:
    """A password without a mixture of characters, as people choose them."""
    return r.choice([
        lambda: _word(r) + r.choice(["", _word(r)]), lambda: "-".join(_word(r) for _ in range(r.randint(2, 4))), lambda: _rand(r, r.randint(6, 16), _AZ + _az), lambda: _rand(r, r.randint(6, 14), _az + "!#%?+*"), lambda: _rand(r, r.randint(6, 14), _09),
        lambda: _rand(r, r.randint(4, 5), _az + _09), lambda: _rand(r, r.randint(8, 14), _az), lambda: _word(r).capitalize() + _word(r), lambda: _word(r).upper() + r.choice(["", "!"]), lambda: _word(r) + "." + _word(r), lambda: _word(r) + "_" + _word(r),
    ])()


_QUOTED = ['{k} = "{v}"', "{k} = '{v}'", '{k}: "{v}",', '{k}="{v}"', 'export {k}="{v}"', 'const {k} = "{v}";', '{k} := "{v}"', '"{k}": "{v}",', '  "{k}": "{v}"', 'connect("host", {k}="{v}", port=5432)', '  --{k} "{v}" \\', "{k} => '{v}',", 'self.{k}: str = "{v}"', 'static const char {k}[] = "{v}";', "  {k}: '{v}'"]
_BARE = ["{k}={v}", "export {k}={v}", "{k}: {v}", "  {k}: {v}", "tool login --{k}={v}", "tool --user bob --{k} {v}"]
_TIGHT = [x for x in _NAMES if not re.search("(?i)token|auth|pass$", x)]


def _plain_line(r: random.Random) -> tuple[str, str | None]:
    """A line where a credential is expected, and a plain one if it is there."""
    k, v, w, p = r.choice(_TIGHT), _plain_value(r), _word(r), r.random()
    if p < 0.36:
        return r.choice(_QUOTED).format(k=k, v=v), v
    if p < 0.46:
        return r.choice(_BARE).format(k=k, v=(v := _plain_value(r))), v
    if p < 0.56:
        v = v.replace("#", "x").replace("?", "y").replace("%", "z")
        return r.choice([*_QUOTED, *_BARE, "psql {v}"]).format(k=r.choice(_PLAIN), v=f"{r.choice(['redis', 'mysql', 'amqp', 'postgresql'])}://{w}:{v}@{_word(r)}.invalid:5432/x"), v
    if p < 0.6:
        return f"$ curl -u {w}:{v} https://{w}.invalid", v
    own, loose = r.choice(["password", "passwd", "db_password", "user_token", "secretName", "PASSWORD", "Password", "pass", "pw", "secret", "passwordField", "accessToken", "token", "your_password", "my-secret"]), r.choice(["token", "auth", "bearer", "pass", "authToken", "credentials", "pin"])
    if p < 0.7:
        return r.choice([*_QUOTED, *_BARE, "url = 'mysql://user:{v}@{k}.invalid/x'"]).format(k=k, v=r.choice([own, own, r.choice(sorted(NO_VALUES)), "*****", "...", "xxxx", "TODO", "<secret>", "{{ x }}", "$PW"])), None
    if p < 0.72:
        v = _rand(r, r.randint(10, 20), r.choice([_AZ + _az, _az, _09]))
        return r.choice(_QUOTED).format(k=loose, v=v), v
    if p < 0.83:
        return r.choice([*_QUOTED, *_QUOTED, *_BARE]).format(k=loose, v=r.choice([w, w.upper(), w.capitalize(), str(r.randint(0, 9999)), f"{w}-{_word(r)}", f"{w}_{_word(r)}", f"{w}.{_word(r)}"])), None
    return r.choice([
        "{k} = {w}", "{k} = {w}({x})", "{k} = {w}.{x}", "{k}: {c}", "{k}: {c};", "{k}: {w},", "{k} = {w}_{x}", "def {w}({k}: {c}, {x}: {c}):", "connect({w}, {k}={w}, port=1)", "{k}={w}.{x}(", "{k} = {w}[{x}]", "{k}: {w}.{x},", "{k} := {w}.{x}(ctx)", "if {k} = {w} {{", "{k} = {n}", "{k}: {n}", "{k}={w})", "{k}={w}.{x})",
        '{k}: "{w} {x} {w}"', '{k} = "{c} {w} {x}"', "{k} = {w};", "{k}={w};", "this.{k} = {w};", "{k}: {w} {x} {w}", "{k} => {w}", "private String {k} = {w};", 'throw new Error("{k}: {w} {x}")', 'log("{k}={w} " + x)', "# {k}: {w} {x} in the vault", "{k}: {w}/{x}", '{k} = "{w}/{x}"', "{k}: {w}:{x}", "the {k}: {w} {x} of it", "var {k} = {w}{c}", "{k} = f\"{{{w}}}\"",
    ]).format(k=k, w=w, x=_word(r), c=_word(r).capitalize(), n=r.randint(0, 9999)), None


def labelled_lines(n: int = TRAIN_LINES, seed: int = 7) -> Iterator[tuple[str, str | None]]:
    """Lines and the credential they hold, if any."""
    r = random.Random(seed)
    for _ in range(n):
        if r.random() < 0.2:
            yield _plain_line(r)
            continue
        form, p = r.choice(_FORMS), r.random()
        if p < 0.34:
            v = _secret_value(r)
            yield form.format(k=r.choice(_NAMES), v=v), v
        elif p < 0.44:
            v = _strong(r)
            yield form.format(k=r.choice(_PLAIN + [_word(r)]), v=v), v
        elif p < 0.52:
            pw = _password(r).replace("!", "%21").replace("#", "%23").replace("?", "x").replace("@", "a").replace("/", "b")
            url = f"{r.choice(['redis', 'mysql', 'amqp', 'ftp', 'https', 'mongodb+srv', 'postgresql'])}://{_word(r)}:{pw}@{_word(r)}.invalid:{r.randint(1000, 9999)}/{_word(r)}"
            yield form.format(k=r.choice([*_PLAIN, "dsn", "DATABASE_URL"]), v=url), pw
        elif p < 0.57:
            kind = r.choice(["Basic", "Bearer"])
            v = _b64(r, f"{_word(r)}:{_password(r)}") if kind == "Basic" else r.choice([_rand(r, 34, _ALNUM), "eyJ" + _rand(r, 20, _ALNUM) + ".eyJ" + _rand(r, 40, _ALNUM) + "." + _rand(r, 43, _ALNUM + "-_"), _rand(r, 64, _09 + "abcdef"), "-".join(_rand(r, 5, _AZ + _09) for _ in range(5)), _rand(r, 38, _ALNUM + "+/")])
            yield form.format(k=r.choice(["header", "auth_header", "hdr"]), v=f"Authorization: {kind} {v}"), v
        elif p < 0.59:
            v = _password(r) if r.random() < 0.8 else _plain_value(r).replace("#", "x").replace("%", "y")
            yield r.choice(["{c} mysql -h {w}.invalid -u {w} -p'{v}' {w}", "{c} echo {v} | sudo -S {w}", '{c} mysqldump -u{w} -p"{v}" {w} > x.sql', "{c} sshpass -p '{v}' ssh {w}@x.invalid", "{c} echo '{v}' | docker login -u {w} --password-stdin", "{c} mysql -u {w} -p{v}"]).format(c=r.choice(["# run:", "$", "//", ";", "-- run:", ""]), w=_word(r), v=v), v
        elif p < 0.6:
            v = _password(r)
            yield r.choice(["# run: curl -u {w}:{v} https://{w}.invalid/{w}", "$ curl -u {w}:{v} https://{w}.invalid", "// curl -s -u {w}:{v} http://x.invalid"]).format(w=_word(r), v=v), v
        elif p < 0.63:
            kind = r.choice(["RSA ", "EC ", "OPENSSH ", ""])
            v = f"-----BEGIN {kind}PRIVATE KEY-----"
            yield r.choice(["{v}", "// {v}", 'const pem = `{v}', '_PEM = """{v}', 'char value[] = "{v}\\nMIIab12"', "# {v}"]).format(v=v), v
        elif p < 0.66:
            yield r.choice(["# {v}", "{v}", "// {v}"]).format(v=r.choice(["-----BEGIN PUBLIC KEY-----", "-----BEGIN CERTIFICATE-----", "-----END PUBLIC KEY-----"])), None
        elif p < 0.74:
            yield form.format(k=r.choice(_NAMES), v=_no_value(r)), None
        elif p < 0.9:
            k, v = _neutral(r)
            yield form.format(k=k, v=v), None
        else:
            w = [_word(r) for _ in range(4)]
            yield r.choice([
                f"{w[0]}.{w[1]}({w[2]}{r.randint(1, 99)}, {w[3]}, 0x{r.randint(1, 999)})", f"const {w[0]}{w[1].capitalize()} = await {w[2]}({{ {w[3]}{r.randint(1, 9)}: 91 }});", f"the {r.choice(_NAMES)} for {w[0]} lives in the vault under {w[1]}/{w[2]}_{w[3]}2", f'    "{_rand(r, 70, _ALNUM + "+/")}"',
                f"{_rand(r, 64, _ALNUM + '+/')}", f"// {_rand(r, 64, _ALNUM + '+/')}", f'router.{w[0]}("/{w[1]}/:{w[2]}Id2/{w[3]}", async (x) => {{', f"in our tests the {w[0]} took 4{r.randint(1, 9)}ms2 and the token {w[1]} was renewed", f"- id: {w[0]}-{r.randint(1, 99)}", f"{_rand(r, 20, _ALNUM)}==",
                f"var {w[0]}={{{w[1]}Scalar:a,{w[2]}{r.randint(1, 99)}:{r.randint(1, 9999)}}};", f" * Upstream: https://{w[0]}.invalid/ at revision {_rand(r, 10, _09 + 'abcdef')}", f"see commit {_rand(r, r.choice([7, 10, 40]), _09 + 'abcdef')} of {w[0]}", f"b'\\x{r.randint(10, 99)}{w[0]}\\xa4{w[1]}\\x0{w[2]}{r.randint(1, 9)}'", f"{w[0]}#{r.randint(100, 99999)} and {w[1]}-{r.randint(100, 99999)}",
                f"throw new {w[0].capitalize()}{w[1].capitalize()}Exception2('{w[2]} {w[3]}')",
                f"return &{w[0].capitalize()}{{{w[1].capitalize()}: {w[2]}{w[3].capitalize()}, {w[3].capitalize()}{w[0].capitalize()}: {r.randint(10, 99999)}}}, nil", f".{w[0]}-{_rand(r, 4, _ALNUM)}{{margin:{r.randint(1, 99)}px 1px;color:#{_rand(r, 6, _09 + 'abcdef')}}}.{w[1]}>.{w[2]}:before{{{w[3]}:{w[0]}}}",
                f"f.{w[0]}Reader=g=>h?ks.{w[1]}Bin(l):i;for(let z=0;p<w.{w[2]};z++)q[s]^={r.randint(100, 9999)};var d=e.{w[3]}{w[0].capitalize()},q=!0;", f'if(a.{w[0]}{w[1].capitalize()}!=="{w[2]}")throw Error(t+"{w[3]}");{w[0]}={{{w[1]}{w[2].capitalize()}:b,{w[3]}{w[1].capitalize()}:{r.randint(1, 9999)}}};',
            ]), None


def _label(toks: list[Token], line: str, secret: str | None) -> list[int]:
    if secret is None:
        return [0] * len(toks)
    lo = line.rfind(secret) if not secret.startswith("-----") else line.find(secret)
    hi, out, began = lo + len(secret), [], False
    for t, may in zip(toks, offered(toks)):
        inside = t.start < hi and t.end > lo and may
        out.append(0 if not inside else 2 if began else 1)
        began = began or inside
    return out


def train(lines: int = TRAIN_LINES, epochs: int = 150, seed: int = 7, l2: float = 2e-4) -> Field:
    """Maximise the likelihood of the labels by gradient steps (Adam) over all lines at once."""
    data = []
    for line, secret in labelled_lines(lines, seed):
        toks = tokens(line)[:48]
        if any(offered(toks)):
            data.append((features(toks), _label(toks, line, secret)))
    counts: dict[str, int] = {}
    for fs, _ in data:
        for f in fs:
            for x in f:
                counts[x] = counts.get(x, 0) + 1
    names = sorted(x for x, c in counts.items() if c >= 5)
    index, none = {n: i for i, n in enumerate(names)}, len(names)
    n, long = len(data), max(len(y) for _, y in data)
    wide = max(len(f) for fs, _ in data for f in fs)
    X, Y, M, bar = np.full((n, long, wide), none), np.zeros((n, long), int), np.zeros((n, long), bool), np.zeros((n, long), bool)
    for a, (fs, y) in enumerate(data):
        for b, f in enumerate(fs):
            ids = [index[x] for x in f if x in index]
            X[a, b, : len(ids)] = ids
            bar[a, b] = "barred" in f
        Y[a, : len(y)], M[a, : len(y)] = y, True
    U, P = np.zeros((none + 1, 3)), np.zeros((3, 3))
    m1, m2, p1, p2 = np.zeros_like(U), np.zeros_like(U), np.zeros_like(P), np.zeros_like(P)
    eye = np.eye(3)
    for e in range(1, epochs + 1):
        s = U[X].sum(2)
        s[bar, 1:] = -30
        s[:, 0, 2] = -30
        alpha = np.zeros((n, long, 3))
        alpha[:, 0] = s[:, 0]
        for t in range(1, long):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + P, axis=1) + s[:, t]
            alpha[:, t] = np.where(M[:, t, None], step, alpha[:, t - 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        beta = np.zeros((n, long, 3))
        gp = np.zeros((3, 3))
        for t in range(long - 2, -1, -1):
            nxt = P + (s[:, t + 1] + beta[:, t + 1])[:, None]
            beta[:, t] = np.where(M[:, t + 1, None], np.logaddexp.reduce(nxt, axis=2), beta[:, t + 1])
            both = np.exp(alpha[:, t, :, None] + nxt - z[:, None, None]) * M[:, t + 1, None, None]
            gp += np.einsum("n,nij->ij", M[:, t + 1].astype(float), eye[Y[:, t]][:, :, None] * eye[Y[:, t + 1]][:, None]) - both.sum(0)
        post = np.exp(alpha + beta - z[:, None, None])
        g = (eye[Y] - post) * M[..., None]
        gu = np.zeros_like(U)
        for k in range(wide):
            np.add.at(gu, X[:, :, k].ravel(), g.reshape(-1, 3))
        gu[none] = 0
        gu, gp = gu / n - l2 * U, gp / n - l2 * P
        m1, m2, p1, p2 = 0.9 * m1 + 0.1 * gu, 0.999 * m2 + 0.001 * gu**2, 0.9 * p1 + 0.1 * gp, 0.999 * p2 + 0.001 * gp**2
        c1, c2 = 1 - 0.9**e, 1 - 0.999**e
        U += 0.15 * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        P += 0.15 * (p1 / c1) / (np.sqrt(p2 / c2) + 1e-8)
    return Field(names, U[:-1], P)


# --- use ------------------------------------------------------------------------------------------------------------

_RUNS = re.compile(rf"[^{_SEP}]{{6,}}")
_OPEN_ENDS = frozenset("=:(\\>|+\"'`")
_OPENS = re.compile(r"[=:(\\>|+]\s*[\"'`]?\s*$")
_BODY = re.compile(r"[A-Za-z0-9+/=]{8,}")
#: A line of a private key: encoded bytes within quotes, marks of a comment or of joining; or a header of an encrypted one.
_KEY_LINE = re.compile(r"""[\s"'`#/*;>|\-.+]*(?:[A-Za-z0-9+/=]{1,}(?:\\[nr])*)+[\s"'`+;,.)\\|]*|\s*(?:Proc-Type|DEK-Info|Comment|Version):.*""")
#: The same within a line, where the letter of an escaped line break comes before it.
_INLINE = re.compile(r"(?:(?<=\\)[nr])?([A-Za-z0-9+/=]{8,})")
#: The rest of a literal that was broken over lines: as one of its own, or within open quotes; and how such a line ends.
_NEXT, _INSIDE = re.compile(r"\s*[+.]?\s*[\"'`]([^\"'`\s]+)[\"'`](?!\s*[:=])"), re.compile(r"\s*([^\s\"'`\\]+)(?:[\"'`]|(?=\\\s*$))")
_JOINED, _CUT = re.compile(r"\s*[+\\.]\s*$"), re.compile(r"\\\s*$")
_field: Field | None = None


def field() -> Field:
    global _field
    if _field is None:
        _field = Field.load()
    return _field


#: What a place for a credential can't be without: a part of such a name, an address, a login.
_EXPECTS = re.compile("(?i)" + "|".join(sorted({w[:4] if w.startswith(("pass", "cred")) else w for w in SECRET_WORDS} | {"key", "passe", "://", r"-u\b", "--user"}, key=len)))
_DIGIT, _CAPITALS = re.compile(r"\d"), re.compile(r"[A-Z]{2}")


def _may_hold(line: str) -> bool:
    """Whether any token of the line may be offered. An admissible one is a part of a run, so
    none is where the runs are words, numbers, or names joined by marks."""
    placed = _EXPECTS.search(line) and ("=" in line or ":" in line or "--" in line) or ("-p" in line and _CLIENT.search(line)) or _reads_pipe(line)
    if "-----BEGIN" in line or (placed and any(offered(tokens(line)))):
        return True
    for run in _RUNS.findall(line):
        if _DIGIT.search(run):
            if not run.isdigit() and _ADMIT.search(run):
                return True
        elif run.isalpha():
            if _CAPITALS.search(run) and not run.isupper() and _ADMIT.search(run):
                return True
        elif not run.islower() and not all(map(_PART.fullmatch, _NAMES_APART.split(run))) and _ADMIT.search(run):
            return True
    return False


_KEY_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY-----")


def _rest_of_key(before: str) -> list[tuple[int, int]]:
    """Spans of key lines, if all that comes before a key's end is such."""
    lines, at, out = before.split("\n"), 0, []
    for n, line in enumerate(lines):
        # the last is what stands before the mark of the end in its line
        if "-----BEGIN" in line or (line.strip(" \t\r\"'`#/*;+") and not _KEY_LINE.fullmatch(line)):
            return []
        out.extend((at + m.start(1), at + m.end(1)) for m in _INLINE.finditer(line) if ":" not in line)
        at += len(line) + 1
    return out


def _left_open(line: str) -> str:
    """The class of the name whose value the next line holds, if this one ends that way."""
    if line.rstrip()[-1:] not in _OPEN_ENDS or not _OPENS.search(line):
        return "none"
    words = re.findall(r"[\w.\-]+", line)
    return name_class(words[-1]) if words else "none"


def find(content: str, crf: Field | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """(line number, spans of characters in ``content``) of each credential; number 0 for the
    rest of a key that began before ``content`` does."""
    crf = crf or field()
    out: list[tuple[int, list[tuple[int, int]]]] = []
    at, carried, goes_on, in_pem = 0, "none", "", False
    end = _KEY_END.search(content) if "PRIVATE KEY-----" in content else None
    if end and (rest := _rest_of_key(content[: end.start()])):
        out.append((0, rest))
    for no, line in enumerate(content.split("\n"), 1):
        start, at = at, at + len(line) + 1
        if in_pem:  # the body of a private key goes with its first line
            if "-----END" in line:
                in_pem = False
                out[-1][1].extend((start + m.start(1), start + m.end(1)) for m in _INLINE.finditer(line.split("-----END")[0]))
                continue
            if not line.strip() or _KEY_LINE.fullmatch(line):
                out[-1][1].extend((start + m.start(1), start + m.end(1)) for m in _INLINE.finditer(line) if ":" not in line)
                continue
            in_pem = False
        if goes_on:  # the rest of a literal that was broken over lines
            m = (_INSIDE if goes_on == "inside" else _NEXT).match(line)
            if m:
                out[-1][1].append((start + m.start(1), start + m.end(1)))
                carried = "none"
                start, line = start + m.end(), line[m.end() :]  # what remains is looked at as any other
                goes_on = "inside" if goes_on == "inside" and _CUT.match(line) else "next" if _JOINED.match(line) else ""
            else:
                goes_on = ""
        if not _may_hold(line) and not (carried == "secret" and any(offered(tokens(line), carried))):
            if line.strip():
                carried = _left_open(line)
            continue
        toks = tokens(line)
        labels = crf.decode(features(toks, carried)) if any(offered(toks, carried)) else []  # linear in the line's length
        for t, y in zip(toks, labels):
            span = (start + t.start, start + t.end)
            if y == 1:
                out.append((no, [span]))
                if t.slot == "pem":
                    out[-1][1].clear()
                    rest = line[t.end :]
                    out[-1][1].extend((start + t.end + m.start(1), start + t.end + m.end(1)) for m in _INLINE.finditer(rest.split("-----END")[0]))
                    in_pem = "-----END" not in rest
                elif re.search(r"[\"'`]\s*(?:[+\\.]\s*)?$", line[t.end :]) and re.match(r"[\"'`]\s*(?:[+\\.]\s*)?$", line[t.end :]) and re.search(r"(?:[+\\.]|^[^()]*\([\"'`][^\"'`]*[\"'`])\s*$", line):
                    goes_on = "next"
                elif t.quoted and _CUT.match(line[t.end :]):
                    goes_on = "inside"
            elif y == 2 and out:
                out[-1][1].append(span)
        carried = _left_open(line)
    return out


def redact(content: str, found: list[tuple[int, list[tuple[int, int]]]]) -> str:
    """Replace exactly the literals; line breaks inside stay where they are."""
    out, at = [], 0
    for lo, hi in sorted({s for _, spans in found for s in spans}):
        if lo >= at and hi > lo:
            out += [content[at:lo], MASK]
            at = hi
    return "".join([*out, content[at:]])


FOUND = "chunk_id string, line_nos array<bigint>, redacted string"


def _rows(keep_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = field()
        for b in batches:
            rows = []
            for i, text in zip(b["chunk_id"], b["content"]):
                found = find(text, crf) if text else []
                if found:
                    rows.append((i, sorted({n for n, _ in found if n}), redact(text, found) if keep_text else None))
            yield pd.DataFrame(rows, columns=["chunk_id", "line_nos", "redacted"])

    return run


def _found(chunks: DataFrame, keep_text: bool) -> DataFrame:
    rows = pick(chunks, "id", "content").where(F.col("content").isNotNull() & F.col("id").isNotNull())
    return spread(rows.select(F.col("id").alias("chunk_id"), "content")).mapInPandas(_rows(keep_text), FOUND)


def credentials(chunks: DataFrame) -> DataFrame:
    """One row per chunk that holds credentials, or the rest of one: the lines where they start, and its redacted content."""
    return _found(chunks, True).dropDuplicates(["chunk_id"])


def credential_lines(chunks: DataFrame) -> DataFrame:
    """chunk_id, line_no: one row per line where a credential starts."""
    # copies of an id give the same lines: dropping those moves less than dropping texts
    return _found(chunks, False).select("chunk_id", F.explode("line_nos").alias("line_no")).dropDuplicates(["chunk_id", "line_no"])


if __name__ == "__main__":
    train().save()
