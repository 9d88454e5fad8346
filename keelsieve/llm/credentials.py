"""Credentials written into source and configuration files: where they stand, and contents without them.

A text is read lexically, line by line: string literals with their quotes and escapes,
bare values of configuration lines, element texts, command-line arguments, comments. A
literal is a credential if it is assigned or passed to something named like one and is
no placeholder, reference, hash or ciphertext; or if its own form says so (issued token
formats, logins inside URLs and connection strings, Authorization values, private keys).
Literals continued on the next line are read as one value. Redaction replaces the inside
of the literals and nothing else, so quotes, escapes, line ends and markers stay.
"""

from __future__ import annotations

import base64
import binascii
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Words of identifiers that name a credential, alone or qualified, and words that make it something else.
CREDENTIAL_WORDS = frozenset("password passwd passphrase passcode pwd pw pass kennwort passwort secret token credential credentials creds apikey authkey auth bearer".split())
KEY_QUALIFIERS = frozenset("api access secret private signing sign encryption encrypt session license licence gateway account storage master deploy auth client shared service app admin hmac".split())
OTHER_WORDS = frozenset(
    "url uri name field label type header hash hint path file filename id ids ttl expiry expires policy length len size count prompt placeholder endpoint env var ref reference pub public digest"
    " fingerprint checksum min max input box text title form regex pattern version algorithm alg issuer audience scope scopes host port user username email limit rotation enabled required column table".split()
)
# Words that mark a value as a stand-in.
STAND_IN_WORDS = frozenset("your changeme change replace insert dummy redacted example placeholder todo fixme fake sample notarealpassword notreal none null nil undefined masked hidden removed goes xxx tbd".split())

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Formats of issued tokens.
_ISSUED = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abeoprs]-[A-Za-z0-9\-]{10,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{32,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_\-]{30,}"
    r"|eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{10,}"
)
ISSUED = re.compile(r"(?<![A-Za-z0-9_\-])(?:" + _ISSUED + ")")
ISSUED_WHOLE = re.compile(_ISSUED + r"\Z")
_TOKEN_START = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|[sr]k_(?:live|test)_|AIza|SG\.|npm_|pypi-|eyJ")
URL_LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://([^\s/:@\"'`<>]*):([^\s/\"'`<>]*[^\s/\"'`<>@])@(?=[A-Za-z0-9\[])|[A-Za-z][A-Za-z0-9+.\-]*://([^\s/:@\"'`<>]*):([^\s\"'`<>]+)@(?=[A-Za-z0-9.\-]+\.[A-Za-z]+)")
PAIR = re.compile(r"(?i)(?:[;?&\s\"'`]|^)(?:password|passwd|pwd)=([^;&\s\"'`]+)")
PAIR_HINT = re.compile(r"(?i)(?:server|host|data source|user id|user|uid|database|sslmode)=|jdbc:")
AUTHORIZATION = re.compile(r"(?i)\b(bearer|basic)\s+([A-Za-z0-9+/=_.~\-]{8,})")
BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
LITERAL = re.compile(r'"((?:\\.|[^"\\])*)"|\'((?:\\.|[^\'\\])*)\'|`([^`]*)`')
_NAME = r"[A-Za-z_$][\w.$\-]*"
_BEFORE = [
    re.compile(r"@\w+\(\s*[\"']([\w.\-]+)[\"']\s*\)\s+\w+\s+\w+\s*=\s*$"),
    re.compile(r"[\"']?(?:key|name)[\"']?\s*[:=]\s*[\"']([\w.\-]+)[\"']\s*,?\s*[\"']?value[\"']?\s*[:=]\s*$"),
    re.compile(r"[\"']([\w.\-]+)[\"']\s*,\s*$"),
    re.compile(r"#define\s+(\w+)\s+$"),
    re.compile(r"\bset([A-Z]\w*)\(\s*$"),
    re.compile(r"(?:[\"'`]|\b)(" + _NAME + r")(?:[\"'`])?\s*\]?\s*(?:\[\s*\])?(?:\s*:?\s*(?:string|str|String|char\s*\*))?\s*(?::=|=>|===?|=|:)\s*\(?\s*$"),
]
#: The value that is taken where a setting is absent: ``password = getenv("X", "...")``, ``token = env.X || "..."``.
_DEFAULT = re.compile(r"(?:[\"'`]|\b)(" + _NAME + r")[\"'`]?\s*(?::\s*\w+\s*)?(?::=|=|:)\s*(?:[\w.\->]+\s*[(\[]\s*[\"'][^\"']*[\"']\s*(?:,\s*(?:default\s*=\s*)?$|[)\]]\s*(?:\|\||\?\?|\bor\b)\s*$)|[\w.]+\s*(?:\|\||\?\?|\bor\b)\s*$)")
#: A line that leaves its value to the next one.
_OPEN = re.compile(r"(?::=|=>|=|:)\s*\(?\s*\\?\s*$")
_TRIPLE = re.compile(r'("""|\'\'\')((?:\\[\s\S]|(?!\1)[\s\S])+?)\1')
_SECOND = re.compile(r"(?i)\b(?:login|auth|authenticate|signin|basic_auth|credentials)\w*\s*[=:]?\s*\(\s*([\"'`])[^\"'`]*\1\s*,\s*$")
_PAIRED_NAME = re.compile(r"^\s*-?\s*(?:name|key)\s*[:=]\s*[\"']?([\w.\-]+)[\"']?\s*,?\s*$")
_PAIRED_VALUE = re.compile(r"^\s*-?\s*value\s*[:=]\s*")
_BARE = re.compile(r"^\s*(?://[^\s=]+?/:|(?:#|//|;|\*)\s*)?(?:export\s+|set\s+|ENV\s+|ARG\s+|-\s+)?[\"']?(" + _NAME + r")[\"']?\s*(::?=|[?+]=|=|:)\s*([^\s\"'`#][^\s]*)\s*(?:[#;].*)?$")
_FLAG = re.compile(r"(?<!\S)--?([A-Za-z][\w\-]*)(?:=|\s+)([^\s\"'`\-][^\s\"'`]*)")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*)(?:\s[^<>]*)?>([^<>]+)</\1>")
_REMARKS = [
    (re.compile(r"\b([A-Za-z_][\w\-]*)\s+(is|was|=)\s+([^\s,;\"'`]+)"), True),
    (re.compile(r"(?i)\blogin\s+(?:is|was)\s+\S+\s*/\s*(\S+)"), False),
    (re.compile(r"(?i)\bmachine\s+\S+\s+login\s+\S+\s+password\s+(\S+)"), False),
    (re.compile(r"(?i)\bcurl\b.*?\s(?:-u|--user)[\s=]+[\"']?[^\s:\"']+:[\"']?([^\s\"'][^\s\"']*)"), False),
    (re.compile(r"(?i)\b(?:mysql|mysqldump|mariadb|sshpass)\b.*?\s-p\s?[\"']?([^\s\"'\-][^\s\"']*)"), False),
]
_REMARK_HINT = re.compile(r"(?i)=|\b(?:is|was|machine|login|curl|mysql|mysqldump|mariadb|sshpass)\b")
# Endings of languages whose strings stand in quotes, so that a bare word is an expression; and of prose.
_PROGRAM = re.compile(
    r"(?i)\.(?:py|pyi|pyw|ipynb|js|mjs|cjs|jsx|ts|tsx|vue|svelte|go|java|kt|kts|scala|groovy|gradle|c|h|cc|cpp|cxx|hh|hpp|m|mm|cs|fs|vb|rb|php|pl|pm|rs|swift|dart|lua|r|jl|ex|exs|erl|hs|clj|sql|json|jsonc|css|scss|less|tf|map)(?:[?#].*)?$"
)
_PROSE = re.compile(r"(?i)\.(?:md|markdown|rst|adoc|txt|log|html?|xml)(?:[?#].*)?$")
_INTERPRETER = re.compile(r"#!.*\b(?:python|node|deno|ruby|perl|php|lua|Rscript)")
_CHAIN = re.compile(r"[!&*+\-~]?[A-Za-z_$][A-Za-z_$]*(?:(?:\.|->|::|\?\.)[A-Za-z_$][\w$]*)+")
_CAMEL = re.compile(r"_*[A-Za-z]+(?:_[A-Za-z]+)*")
#: Operands joined by operators, numbers and names with members.
_EXPRESSION = re.compile(r"[!&*+\-~]*(?:[A-Za-z_$][\w$]*[!?]?|\d[\d_.]*(?:[eE]\d+)?[A-Za-z]{0,2}|0x[0-9a-fA-F]+)(?:(?:\.|->|::|\?\.|[-+*/%|&^<>=?:]+)(?:[A-Za-z_$][\w$]*[!?]?|\d[\w.]*))*")
_REFERENCE = re.compile(r"(?i)\$\{|\$\(|^\$|\{\{|%\(|^%\w+%$|^<.*>$|^\[.*\]$|^(?:ref\+|ssm:|vault:|arn:|secretkeyref|env:|env\.|file:|op://|kv/|@|\*|&)|getenv|environ|process\.env|secrets?\.|^https?://[^@]*$")
#: What one of the forms below has in lower case; lines without any are passed over. Names come from the vocabularies above, so
#: that the test is never narrower than they are: a word that ends in or holds a shorter one of the list is left to that one.
_NAMED = sorted(CREDENTIAL_WORDS | {"key", "pem"})
_HINTS = tuple(w for w in _NAMED if not any(v != w and v in w for v in _NAMED)) + (
    "://", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat", "glpat-", "xox", "k_live_", "k_test_", "aiza", "sg.", "npm_", "pypi-", "eyj",
    "basic", "login", "signin", "authenticate", "curl", "mysql", "mariadb", "value",
)
_SEALED = re.compile(r"(?i)^(?:ENC\[|\$2[abxy]?\$|\$[156y]\$|\$argon2|\$pbkdf2|pbkdf2|scrypt:|bcrypt|\{(?:ssha|sha|crypt|cipher)\}|sha(?:1|224|256|384|512)[:\-]|[\w.\-]+:hmac-sha\d+:|-----BEGIN|ssh-(?:rsa|ed25519) |data:|AQICAH|vault:v\d)")


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name)]


def names_credential(name: str, _known: dict = {}) -> bool:
    """Whether an identifier, in whatever style it is written, names a credential."""
    got = _known.get(name)
    if got is None:
        words = _words(name)
        joined = "".join(words)
        tail = words[-1] if words else ""
        got = bool(words) and tail not in OTHER_WORDS and (
            any(w in CREDENTIAL_WORDS for w in words)
            or any(w.endswith(("password", "passwd", "passphrase", "apikey")) for w in words)
            or (tail in ("key", "keys", "pem") and any(w in KEY_QUALIFIERS for w in words[:-1]))
            or joined.endswith(("apikey", "secretkey", "accesskey"))
        )
        if len(_known) < 100_000:
            _known[name] = got
    return got


def _stand_in(value: str) -> bool:
    if _REFERENCE.search(value) or _SEALED.match(value):
        return True
    core = re.sub(r"[^A-Za-z0-9]", "", value)
    if not core or len(set(core.lower())) <= 2:
        return True
    tail = core[-12:].lower()
    if len(core) >= 16 and len(set(tail)) == 1:
        return True
    parts = {w.lower() for w in re.findall(r"[A-Za-z]+", value)}
    if parts & STAND_IN_WORDS:
        return True
    plain = core.lower()
    return any(w in plain for w in ("notareal", "changeme", "placeholder", "yourpassword", "insertpassword", "replaceme"))


# Words of sentences, which a pass phrase does without.
_SENTENCE_WORDS = frozenset("a an and any are as at be by can cannot could do does enter failed for from has have if in invalid is it its may must no not of on or our please should that the this to too was were when will with wrong you your choose type pick use click see set reset forgot create confirm change update check show hide new old".split())
_SPOKEN_NAMES = frozenset("help error message msg info tip warning description note title text label hint prompt question".split())
_PHRASE_NAMES = frozenset("password passwd passphrase passcode pwd pw pass kennwort passwort".split())


def phrase(value: str, name: str) -> bool:
    """Whether a quoted value of something named like a password is a pass phrase: words that make no sentence and name nothing themselves, or one long such word."""
    words = _words(name)
    if not words or _SPOKEN_NAMES & set(words) or not any(w in _PHRASE_NAMES or w.endswith(("password", "passwd", "passphrase")) for w in words[-2:]) or words[-1] in OTHER_WORDS:
        return False
    v = value.strip()
    parts = re.split(r"[\s\-_.]+", v)
    if len(v) > 120 or not all(re.fullmatch(r"[A-Za-z0-9!?@#$%^&*+=,']+", x) for x in parts) or _stand_in(v.replace(" ", "-")):
        return False
    low = [x.lower() for x in parts]
    if any(w in _SENTENCE_WORDS or w in OTHER_WORDS or w in CREDENTIAL_WORDS or w in KEY_QUALIFIERS for w in low):
        return False
    if len(parts) == 1:
        return v.isalpha() and v.islower() and len(v) >= 12 and not any(w in v for w in (*CREDENTIAL_WORDS, *OTHER_WORDS, *STAND_IN_WORDS) if len(w) > 3)
    return 3 <= len(parts) <= 12 and len(v) >= 12 and not v.endswith((".", "!", "?"))


def plausible(value: str, least: int = 5) -> bool:
    """Whether a literal can be a secret at all: no placeholder, reference, hash, ciphertext or plain word."""
    v = value.strip()
    if len(v) < least or re.search(r"\s", v) or _stand_in(v):
        return False
    if re.fullmatch(r"(?i)true|false|yes|no|on|off|enabled|disabled|default|required|optional|\d{1,5}", v):
        return False
    return not re.fullmatch(r"[a-z]+(?:[_\-./ ][a-z]+)*|[A-Z]?[a-z]+|[A-Z]+(?:_[A-Z]+)*|[A-Z][a-z]+(?:-[A-Z][a-z]+)+", v) or len(v) > 40


def _language(text: str, path: str) -> str:
    if _PROGRAM.search(path) or _INTERPRETER.match(text):
        return "program"
    return "prose" if _PROSE.search(path) else ""


def _expression(value: str, language: str) -> bool:
    """Whether an unquoted right side is an expression of a programming language instead of a value."""
    v = value.rstrip(",;")
    if re.search(r"\w\(|\)$", v):
        return True
    if language == "program":
        return bool(re.search(r"[()\[\]{}<>]|=>|&&|\|\|", v) or _EXPRESSION.fullmatch(v))
    # elsewhere a bare word is a value, unless it stands in prose or a statement's end follows
    return (language == "prose" or value.endswith(";")) and bool(_CHAIN.fullmatch(v) or _CAMEL.fullmatch(v))


def _decoded(value: str) -> str | None:
    try:
        raw = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return None
    return raw if raw.isprintable() and raw else None


def _login(value: str) -> bool:
    raw = _decoded(value)
    return bool(raw) and ":" in raw and plausible(raw.split(":", 1)[1], 3)


def _hinted_lines(text: str) -> list[int]:
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: look at every line
        return list(range(text.count("\n") + 1))
    at: set[int] = set()
    for hint in _HINTS:
        i = low.find(hint)
        while i >= 0:
            end = low.find("\n", i)
            at.add(i)
            if end < 0:
                break
            i = low.find(hint, end)
    if not at:
        return []
    out, line, last = [], 0, 0
    for i in sorted(at):
        line += low.count("\n", last, i)
        last = i
        if not out or out[-1] != line:
            out.append(line)
    return out


def find(text: str | None, path: str = "") -> list[tuple[int, int, int, str]]:
    """Spans (line number, start, end, kind) of the credentials of a text, pieces of one value under its first line.

    NULL and empty texts have none. Offsets are characters; lines are split at LF and counted from 1.
    """
    if not text:
        return []
    hinted = _hinted_lines(text)
    if not hinted:
        return []
    found: list[tuple[int, int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(line: int, start: int, end: int, kind: str) -> None:
        if not any(s < end and start < e for s, e in taken):
            taken.append((start, end))
            found.append((line, start, end, kind))

    language = _language(text, path)
    sealed_manifest = bool(re.search(r"(?m)^\s*kind:\s*Secret\s*$", text))
    lines = text.split("\n")
    at, offsets = 0, []
    for x in lines:
        offsets.append(at)
        at += len(x) + 1
    for m in BEGIN.finditer(text):
        end = text.find("-----END", m.end())
        end = end if end >= 0 else len(text)
        if "ENCRYPTED" in m[1] or text.find("Proc-Type: 4,ENCRYPTED", m.end(), end) >= 0:
            continue
        body = [b for b in re.finditer(r"[A-Za-z0-9+/=]{4,}", text[m.end() : end])]
        body = [b for b in body if not (b[0][0] in "nr" and text[m.end() + b.start() - 1] == "\\" and len(b[0]) == 1)]
        if sum(len(b[0]) for b in body) < 40:
            continue
        line = text.count("\n", 0, m.start()) + 1
        taken.append((m.start(), end))
        for b in body:
            shift = 1 if text[m.end() + b.start() - 1] == "\\" and b[0][0] in "nr" else 0
            found.append((line, m.end() + b.start() + shift, m.end() + b.end(), "private key"))
    for m in _TRIPLE.finditer(text):
        inner = m[2]
        line_start = text.rfind("\n", 0, m.start()) + 1
        p = _BEFORE[-1].search(text[line_start : m.start()])
        value = inner.strip()
        if p and names_credential(p[1]) and not re.search(r"\s", value) and plausible(value):
            start = m.start(2) + len(inner) - len(inner.lstrip())
            add(text.count("\n", 0, start) + 1, start, start + len(value), "named literal")
    # a name may stand at the end of the line before its value
    hinted = sorted({*hinted, *(i + 1 for i in hinted if i + 1 < len(lines) and _OPEN.search(lines[i]))})
    skip_to = -1
    for i in hinted:
        line = lines[i]
        paired = None
        if i and _PAIRED_VALUE.match(line):
            p = _PAIRED_NAME.match(lines[i - 1])
            paired = p[1] if p else None
        if i <= skip_to:
            continue
        base = offsets[i]
        no = i + 1
        for m in ISSUED.finditer(line):
            if not _stand_in(m[0]):
                add(no, base + m.start(), base + m.end(), "token")
        if "://" in line and "@" in line:
            for m in URL_LOGIN.finditer(line):
                g = 2 if m[2] is not None else 4
                if not _stand_in(m[g]) and len(m[g]) >= 3:
                    add(no, base + m.start(g), base + m.end(g), "url login")
        if PAIR_HINT.search(line):
            for m in PAIR.finditer(line):
                if not _stand_in(m[1]) and len(m[1]) >= 4:
                    add(no, base + m.start(1), base + m.end(1), "connection string")
        for m in AUTHORIZATION.finditer(line):
            basic = m[1].lower() == "basic"
            if (basic and _login(m[2])) or (not basic and len(m[2]) >= 16 and plausible(m[2])):
                add(no, base + m.start(2), base + m.end(2), "authorization")
        literals = list(LITERAL.finditer(line))
        above = ""
        if i and literals and not line[: literals[0].start()].strip() and _OPEN.search(lines[i - 1]):
            above = re.sub(r"\(?\s*\\?\s*$", "", lines[i - 1])
        for number, m in enumerate(literals):
            g = m.lastindex or 1
            value, start, end = m[g] or "", m.start(g), m.end(g)
            if len(value) < 3:
                continue
            # whatever names a value stands after the third literal before it
            before = line[literals[number - 3].start() if number > 2 else 0 : m.start()] if number or not above else above
            name = paired if paired and _PAIRED_VALUE.fullmatch(line[: m.start()]) else None
            second = False
            if name is None:
                for rx in _BEFORE:
                    p = rx.search(before)
                    if p:
                        name = p[1]
                        break
                else:
                    second = bool(_SECOND.search(before))
                if name is None or not names_credential(name):
                    p = _DEFAULT.search(before)
                    if p and names_credential(p[1]):
                        name = p[1]
                if name is not None and not names_credential(name) and rx is _BEFORE[2]:
                    second = bool(_SECOND.search(before))
            # the value may go on in literals of the following lines
            pieces = [(start + base, end + base)]
            j, rest, whole = i, line[m.end() :], value
            # only where the whole can be a credential: long runs of data literals are read once, not from each of their lines
            goes_on = (name is not None and names_credential(name)) or second or bool(_TOKEN_START.match(value)) or "://" in value
            while goes_on and j + 1 < len(lines) and re.fullmatch(r"\s*[+.&]?\s*\\?\s*", rest) and re.search(r"[+\\.&]\s*$|^\s*$", rest):
                nxt = re.match(r"\s*(?:[+.&]\s*)?", lines[j + 1])
                q = LITERAL.match(lines[j + 1], nxt.end())
                if not q or (not rest.strip() and not (nxt[0].strip() or "(" in before[-40:])):
                    break
                h = q.lastindex or 1
                whole += q[h] or ""
                pieces.append((offsets[j + 1] + q.start(h), offsets[j + 1] + q.end(h)))
                j, rest = j + 1, lines[j + 1][q.end() :]
            kind = None
            if name is not None and names_credential(name):
                tested = _decoded(whole) if sealed_manifest and _decoded(whole) else whole
                if name.lower().split(".")[-1] == "auth" and _login(whole):
                    kind = "encoded login"
                elif plausible(tested) or phrase(tested, name):
                    kind = "named literal"
            elif second and plausible(whole):
                kind = "passed literal"
            elif len(pieces) > 1 and ISSUED_WHOLE.match(whole) and not _stand_in(whole):
                kind = "token"
            elif len(pieces) > 1 and (u := URL_LOGIN.search(whole)) and not _stand_in(u[2] or u[4]):
                kind = "url login"
            if kind:
                for s, e in pieces:
                    add(no, s, e, kind)
                if len(pieces) > 1:
                    skip_to = j
        for m in _ELEMENT.finditer(line):
            if names_credential(m[1]) and plausible(m[2]):
                add(no, base + m.start(2), base + m.end(2), "named literal")
        if "--" in line or " -" in line:
            for m in _FLAG.finditer(line):
                if names_credential(m[1]) and plausible(m[2]):
                    add(no, base + m.start(2), base + m.end(2), "argument")
        remark = line.lstrip()[:1] in "#/*;"
        m = _BARE.match(line)
        if m and names_credential(m[1]) and m[3][:1] not in "[{|>":
            value = m[3].rstrip(",;")
            tested = _decoded(value) if sealed_manifest and _decoded(value) else value
            if plausible(tested) and not re.search(r"\w\(|\)$", value) and (remark or not _expression(m[3], language)):
                add(no, base + m.start(3), base + m.start(3) + len(value), "named value")
        elif paired and names_credential(paired):
            v = _PAIRED_VALUE.match(line)
            value = line[v.end() :].strip()
            if value and value[0] not in "\"'`" and plausible(value) and not _expression(value, language):
                add(no, base + v.end(), base + v.end() + len(value), "named value")
        if _REMARK_HINT.search(line):
            for rx, named in _REMARKS:
                for m in rx.finditer(line):
                    g = 3 if named else 1
                    if named and m[2] == "=" and _expression(m[g] + line[m.end() : m.end() + 1].strip(), language):
                        continue
                    value = m[g].rstrip(",;.")
                    if (not named or names_credential(m[1])) and plausible(value):
                        add(no, base + m.start(g), base + m.start(g) + len(value), "remark")
    found.sort(key=lambda x: x[1])
    return found


#: An escape is one unit, so that what is left of a literal never holds half of one. Line ends, quotes and backslashes stay as they are.
_UNIT = re.compile(r"\\(?:x[0-9A-Fa-f]{1,2}|u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|N\{[^}\n]*\}|[0-7]{1,3}|\r?\n|[\s\S])|[\s\S]")


def _masked(m: re.Match) -> str:
    t = m[0]
    return t if t in ("\n", "\r") or (t[0] == "\\" and t[1:] in ("\n", "\r\n", "n", "r", "t", "\\", '"', "'", "`", "$")) else "*" * len(t)


def mask(text: str | None, spans: list[tuple[int, int, int, str]]) -> str | None:
    """``text`` with the characters of the spans replaced, escapes of line ends and delimiters and everything outside them kept."""
    if not text or not spans:
        return text
    out, at = [], 0
    for _, start, end, _ in spans:
        out += [text[at:start], _UNIT.sub(_masked, text[start:end])]
        at = end
    return "".join([*out, text[at:]])


_SPANS = "array<struct<line_no:int,start:int,stop:int,kind:string>>"


def locate(artifacts: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """One row per credential span: all columns but the content, with ``line_no``, ``start``, ``stop``, ``kind``."""

    @F.pandas_udf(_SPANS)
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("line_no", "start", "stop", "kind"), x)) for x in find(t, p)] for t, p in zip(texts, paths)], dtype=object)

    rest = [c for c in artifacts.columns if c != content and c not in ("line_no", "start", "stop", "kind")]
    return artifacts.select(*rest, F.explode(run(F.col(content), F.coalesce(F.col(path), F.lit("")))).alias("__s")).select(*rest, "__s.*")


def redact(artifacts: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """``artifacts`` with credentials masked in the content; texts without any come out unchanged, NULL stays NULL."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([mask(t, find(t, p)) for t, p in zip(texts, paths)], dtype=object)

    return artifacts.withColumn(content, run(F.col(content), F.coalesce(F.col(path), F.lit(""))))
