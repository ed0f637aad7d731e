"""Credentials in code, configuration and prose: where their bare values lie, and the text with them masked.

A lexer reads a text once, from left to right: names (identifiers and options), quotes with their escape level, line ends and blanks
(escaped ones too, as code lies inside JSON strings), signs, opening lines of key blocks, and words of other scripts. A name that
names a credential is followed in value mode: what closes it, the operator, the opening quote, the literal up to the quote of the
same escape level. Names that pass a value in another way (options of a command, arguments of a login call, the scheme of an
authorization, the user part of a link) are rules on the same tokens. Literals that refer to something else (variables, calls,
templates) or stand for something (placeholders, masks) are no credentials. A word for a credential in running text takes the next
word of its sentence that can be none. Only the literal's content is masked, so delimiters and escapes of the surrounding code stay
as they are. Every rule looks ahead over text that no other token of its kind looks over again, so the time is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "[REDACTED]"

# Forms of tokens that name their issuer.
ISSUED = (
    r"AKIA[0-9A-Z]{16}",
    r"ASIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{30,}",
    r"github_pat_[A-Za-z0-9_]{30,}",
    r"glpat-[A-Za-z0-9_-]{18,}",
    r"AIza[A-Za-z0-9_-]{30,}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"sk_live_[A-Za-z0-9]{16,}",
    r"xox[abeprs]-[A-Za-z0-9-]{16,}",
    r"npm_[A-Za-z0-9]{30,}",
    r"pypi-[A-Za-z0-9_-]{30,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
)
# Words that name a credential when they end a name, and words that need another before them.
CREDENTIAL_WORDS = frozenset("password passwd passwort passphrase passcode pwd pass pw secret token apikey credential credentials authtoken accesstoken authkey secretkey accesskey privatekey psk".split())
KEY_OWNERS = frozenset("api service secret access private signing encryption auth client master shared storage account server license deploy app admin webhook ssh hmac jwt session cookie encrypt sign bot user".split())
SESSION_NAMES = frozenset("sessionid sid jsessionid phpsessid connectsid session sessiontoken sessionkey".split())
# Words that stand for a value, compared without letter case.
STAND_INS = frozenset(
    "none null nil undefined true false string str int bool boolean bytes text required optional secret password passwd pwd token key value "
    "changeme change_me replace_me replaceme replace-me todo tbd fixme redacted masked hidden removed example sample dummy placeholder test "
    "your_password your-password yourpassword your_token your-token insert_here n/a na unset empty secretstr function number any input".split()
)
# Words for a credential in running text of several languages.
PROSE_WORDS = r"passwords?|passphrase|passcode|tokens?|secret|api[ _-]?keys?|access[ _-]?key|credentials?|kennwort|passwort|schlüssel|zugangsdaten|mot de passe|mdp|jeton|clé|contraseña|clave|senha|chave|ficha|пароль|пароля|паролем|токен|токена|ключ|parola|password|비밀번호|비번|암호|토큰|키|パスワード|トークン|暗証番号|キー|密码|密碼|口令|令牌|密钥|密鑰|كلمة المرور|كلمة السر|الرمز|पासवर्ड|कूटशब्द|टोकन|รหัสผ่าน|โทเคน|пін"

# Commands that take a password with an option: -p after "login", -p without a blank, -p, and user:value.
LOGIN_COMMANDS = frozenset("docker podman helm oc az npm".split())
TIGHT_COMMANDS = frozenset("mysql mysqldump mysqladmin".split())
PASS_COMMANDS = frozenset(["sshpass"])
USER_COMMANDS = frozenset("curl http wget".split())
USER_OPTIONS = frozenset("-u --user -a --auth".split())
# Functions whose first or second argument is a password, and words that a password follows after a blank.
LOGIN_CALLS = frozenset("login log_in signin sign_in authenticate auth connect logon basic_auth HTTPBasicAuth set_password setPassword".split())
SERVER_WORDS = frozenset("AUTH requirepass masterauth".split())
# What a name of a credential has in it.
HINTS = r"pass|pwd|pw(?![a-z])|secret|token|key|auth|credential|psk|sess|sid(?![a-z])"

#: A number of words that no credential has: a longer literal is running text.
RUNNING_WORDS = 12

_TOKEN = re.compile(
    r"(?P<block>-----BEGIN [A-Z0-9 ]+-----)|(?P<name>[A-Za-z0-9_$-]+)|(?P<gap>[ \t]+|\\+t)|(?P<line>\r?\n|\\+r\\+n|\\+[nr])|(?P<quote>\\*[\"'`])|(?P<link>://)|(?P<colon>:)"
    r"|(?P<foreign>[^\x00-\x7f]+)|(?P<mark>[^A-Za-z0-9_$\-\s:\\\"'`\x80-\U0010ffff]+|\\+|\s)"
)
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END [A-Z0-9 ]+-----")
_ISSUED = re.compile("|".join(ISSUED))
_HINT = re.compile(HINTS, re.I)
_USER = re.compile(r"[^\s:/@\"'\\<>`]*:(?P<value>[^\s/@\"'\\<>`]+)@(?=[\w\[{$%])")
_SCHEME_AFTER = re.compile(r"[\"'\\\]]*\s*[:=,]\s*[\"'\\]*\s*(?:bearer|basic|token|digest|apikey|negotiate)\s+(?P<value>[^\s\"'\\,;<>`)]+)", re.I)
_SCHEME = re.compile(r"\s+(?P<value>[A-Za-z0-9+/_.~-]{16,}=*)")
_MACHINE = re.compile(r"\s+\S+\s+password\s+(?P<value>[^\s\"'\\]+)")
_IDENTIFIED = re.compile(r"\s+by\s+(?:=\s*)?\\*['\"](?P<value>[^'\"\\]+)", re.I)
_SQL_PASSWORD = re.compile(r"\s+(?:=\s*)?\\*['\"](?P<value>[^'\"\\]+)")
_SERVER = re.compile(r"\s+(?P<value>[^\s\"'\\]{8,})")
_ARGUMENT = re.compile(r"\(\s*(?:\\*[\"'][^\"'\\\n]*\\*[\"']\s*,\s*)?\\*[\"'](?P<value>[^\"'\\\s]{6,})\\*[\"']\s*[,)]")
_OPTION = re.compile(r"[ =]?(?P<value>[^\s\"'\\]+)")
_OPTION_TIGHT = re.compile(r"(?P<value>[^\s\"'\\-][^\s\"'\\]*)")
_OPTION_WIDE = re.compile(r"\s*(?P<value>[^\s\"'\\]+)")
_OPTION_USER = re.compile(r"[ =]\\*[\"']?[^\s:\"'\\]+:(?P<value>[^\s\"'\\]+)")
_PGPASS = re.compile(r":(?:\d{2,5}|\*):[\w*.-]+:[\w*.-]+:(?P<value>[^\s\"'\\:]+)")
_SET = re.compile(r"set\s+(?:-[A-Za-z]+\s+)+$|setx\s+$|(?:config set|config:set|env:set|secret set|secrets set)\s+$")
_QUOTE = re.compile(r"(\\*)([\"'`])")
_AFTER_NAME = re.compile(r"(?:\\*[\"'`])?\]?(?:[ \t]*:[ \t]*(?:str|string|String|SecretStr|bytes|Optional\[str\])(?=[ \t]*=))?[ \t]*(?P<op>:=|=>|->|==|!=|===|!==|=|:)(?!:)[ \t]*")
_ASSIGNS = re.compile(r"\\*[\"'`]?\]?[ \t]*[=:]")
_BARE = re.compile(r"[^\s\"'`\\,;<>()\[\]{}]+")
_PARAMETER = re.compile(r"[^\s\"'`\\,;<>()\[\]{}&]+")
_WAS = re.compile(r"\\*[\"'`]?[ \t]+(?:was|is|were|used to be|changed to|set to)[ \t]+(?:now[ \t]+)?\\*[\"'`]?")
_SPACE = re.compile(r"(?:[ \t]|\\t)*")
_NEXT_LINE = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n)(?:[ \t]|\\t|\d+(?:\t|\\t))*")
_VALUE_LINE = re.compile(r"(?:- )?\\*[\"']?(?:value|Value|VALUE)\\*[\"']?[ \t]*[:=][ \t]*")
_XML_VALUE = re.compile(r"\\*[\"']\s+(?:value|Value)=")
_PROSE = re.compile(r"(?:(?<![A-Za-z0-9_.$/-])|(?<=\\[ntr]))(?:" + PROSE_WORDS + r")(?![A-Za-z0-9_$]|\.\w)", re.I)
_FOREIGN = re.compile("(?:" + "|".join(w for w in PROSE_WORDS.split("|") if not w.isascii() and not w[0].isascii()) + r")(?![A-Za-z0-9_$]|\.\w)", re.I)
_LONGEST = max(map(len, PROSE_WORDS.split("|")))
_PROSE_TOKEN = re.compile(r"[^\s\"'`\\,;()\[\]{}<>「」『』“”«»„。、，：]+")
_SENTENCE_END = re.compile(r"\n|\\n|[.!?。！？](?:\s|$)")


def _heads() -> tuple[tuple[str, ...], frozenset[str]]:
    """How the name begins in which a word for a credential lies: in front, or (where a letter of another script follows) exactly."""
    front, exact = set(), set()
    for word in PROSE_WORDS.split("|"):
        head = re.match(r"[a-z]*", word).group()
        if head:
            (exact if word[len(head) :][:1] > "\x7f" else front).add(head[:-1] if word[len(head) :].startswith("?") else head)
    return tuple(front), frozenset(exact)


_FRONT, _EXACT = _heads()


@lru_cache(maxsize=100_000)
def credential_name(name: str) -> bool:
    """Whether a name is one of something that grants access: its last word decides (``password_min_length`` is a length)."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name.strip("-_$"))]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return False
    last, before = parts[-1], parts[-2] if len(parts) > 1 else ""
    if last in CREDENTIAL_WORDS or last.endswith(("password", "passwd", "passphrase", "apikey", "authtoken", "secretkey")):
        return True
    if last == "key":
        return before in KEY_OWNERS
    if last == "id":
        return before == "key" and len(parts) > 2 and parts[-3] == "access"
    if last == "hash" or last == "base":
        return False
    if "".join(parts) in SESSION_NAMES:
        return "".join(parts) not in ("session", "sid")
    return last == "auth" and len(parts) <= 2


def stands_for_something(value: str, quoted: bool) -> bool:
    """Whether a literal is empty, a placeholder, a mask, or a reference to something else."""
    v = value.strip()
    low = v.lower()
    core = low.strip("<>[]{}()*\"'%$#-_ ")
    if len(v) < 4 or not core or low in STAND_INS or core in STAND_INS:
        return True
    if re.match(r"[$@]?[{(<\[]|\$[A-Za-z_]|%[({A-Za-z_]+[)}%]|%s$|#\{|\{\{|<%", v) or re.search(r"\$\{|\{\{|\}\}|%\(|<%=", v):
        return True
    if re.fullmatch(r"(.)\1*", core) or re.search(r"\*{3,}|x{5,}|X{5,}|\.{3,}|•{3,}|_{4,}", v):
        return True
    if re.search(r"(?:^|[_\W])(?:your|my)[_-]|(?:redacted|replace|change[_-]?me|placeholder|example|insert|dummy|masked|todo)(?:$|[_\W])", low):
        return True
    if re.match(r"(?:process\.env|os\.environ|os\.getenv|env\.|settings\.|config\.|vault:|ref:|secretref|file:|arn:|projects/)", low):
        return True
    if re.fullmatch(r"(?:~|\.{1,2})?(?:/[\w.-]+)+/?", v) and not re.search(r"[A-Za-z0-9]{20,}", v) or re.match(r"[A-Za-z][\w+.-]*://", v):
        return True
    if re.fullmatch(r"[\d.,]+(?:e[+-]?\d+)?[smhd%]?|0x[0-9a-f]+", low):
        return not (quoted and len(v) >= 6)
    if not quoted:
        # a name, a path of names, or a name with a number is a reference
        if re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+[!?]?", v) and not _letters_between_digits(v):
            return True
        if _random_letters(v):
            return False
        if re.fullmatch(r"[A-Za-z_$]+[!?.]?", v) or re.fullmatch(r"[a-z]+(?:_[a-z]+|_\d+)+", v) or re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)+\d{0,2}", v):
            return True
    else:
        if re.fullmatch(r"[A-Za-z]+(?:[ _-][a-z]+)*", v) and not _passphrase(v) and not _random_letters(v):
            return len(v) < 16 or " " in v or "_" in v or v.islower()
        if " " in v.strip() and not re.search(r"\d", v):
            return True
    return False


def _letters_between_digits(v: str) -> bool:
    first = re.search(r"\d", v)
    last = re.search(r"\d(?=\D*$)", v) if first else None
    return bool(last) and re.search(r"[A-Za-z]", v[first.end() : last.start()]) is not None


def _random_letters(v: str) -> bool:
    """Letters in a mix of cases that no naming style gives."""
    if len(v) < 10 or not re.fullmatch(r"[A-Za-z_-]+", v) or v.isupper() or v.islower():
        return False
    return not any(re.fullmatch(r"_*[A-Z]{0,4}[a-z]*(?:[A-Z]{1,4}[a-z]{2,})*[A-Z]{0,4}", p) for p in [v]) and not re.fullmatch(r"[A-Za-z][a-z]*(?:[_-][A-Za-z][a-z]*)+|[A-Z]+(?:[_-][A-Z]+)+", v)


def _passphrase(v: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z]+(?:[-.][A-Za-z]+){2,}", v))


def looks_secret(v: str) -> bool:
    """Whether a word of running text cannot be an ordinary word: letters and digits or signs mixed, of some length."""
    if len(v) < 8 or not v.isascii() or stands_for_something(v, False):
        return False
    if re.match(r"[A-Za-z]+://|www\.|/|\./", v) or re.fullmatch(r"[\w./-]+\.(?:py|ts|js|mjs|json|ya?ml|toml|sql|md|txt|sh|xml|html?)", v):
        return False
    if _random_letters(v) and len(v) >= 12 or _ISSUED.match(v) or _passphrase(v) and re.search(r"[A-Z]", v):
        return True
    letters, digits = re.search(r"[A-Za-z]", v), re.search(r"\d", v)
    signs = re.search(r"[!#%^&*+=@$~?]", v)
    if not letters or not (digits or signs):
        return False
    if re.fullmatch(r"[a-z]+(?:[_-][a-z]+)*[_-]?\d{0,4}", v) or re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)*\d{0,2}", v) or re.fullmatch(r"v?\d[\d.,:/-]*[a-z]{0,3}", v):
        return False
    return True


def _literal(text: str, at: int, parameter: bool = False) -> tuple[int, int, bool] | None:
    """The literal that starts at ``at``: its content's start and end, and whether it is quoted. None where an expression starts."""
    q = _QUOTE.match(text, at)
    if q:
        close = q.group(0)
        end = text.find(close, q.end())
        while end > 0 and not close.startswith("\\") and text[end - 1] == "\\" and end > q.end():
            end = text.find(close, end + 1)
        end = len(text) if end < 0 else end
        stop = text.find("\n", q.end(), end)
        # a string doesn't run over lines, but for key blocks
        if stop >= 0 and not text.startswith("-----BEGIN", q.end()):
            end = stop
        return q.end(), end, True
    b = (_PARAMETER if parameter else _BARE).match(text, at)
    if not b:
        return None
    after = text[b.end() : b.end() + 1]
    if after in ("(", "[") or (after == "{" and b.group(0)[-1:] in "$#%"):
        return None
    return b.start(), b.end(), False


def _assigned(text: str, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    """The literals that the name at start..end gets: assigned, passed, as an element's or an attribute's content."""
    name_open = text[start - 1 : start]
    # <name>value</name>
    if name_open == "<" and text[end : end + 1] == ">":
        close = text.find("<", end + 1)
        if close > 0 and text.startswith("</", close):
            yield end + 1, close, True
        return
    # key="name" value="..."
    x = _XML_VALUE.match(text, end)
    if x and re.search(r"(?:key|name)=\\*[\"']$", text[max(0, start - 12) : start]):
        if lit := _literal(text, x.end()):
            yield lit
        return
    # name: X <line> value: Y
    if re.search(r"\bname\\*[\"']?[ \t]*[:=][ \t]*\\*[\"']?$", text[max(0, start - 14) : start], re.I):
        n = _NEXT_LINE.match(text, end + len((_QUOTE.match(text, end) or [""])[0]) if _QUOTE.match(text, end) else end)
        if not n:
            n = re.compile(r"\\*[\"']?,?[ \t]*(?=\\*[\"']?value)").match(text, end)
        if n and (v := _VALUE_LINE.match(text, n.end())):
            if lit := _literal(text, v.end()):
                yield lit[0], lit[1], True
        return
    before = text[max(0, start - 40) : start]
    if _SET.search(before):
        s = _SPACE.match(text, end)
        if s.end() > end and (lit := _literal(text, s.end())):
            yield lit[0], lit[1], True
        return
    a = _AFTER_NAME.match(text, end)
    if not a:
        # the name is one of running text: "old api_key was VALUE"
        if (w := _WAS.match(text, end)) and (lit := _literal(text, w.end())) and looks_secret(text[lit[0] : lit[1]].rstrip(".:!?")):
            yield lit[0], lit[1], True
            return
        # --password value
        if before.endswith("--") and (s := re.compile(r"[ \t]+").match(text, end)) and (lit := _literal(text, s.end())):
            yield lit[0], lit[1], True
        return
    if a.group("op") in ("==", "!=", "===", "!==", "->"):
        return
    at = a.end()
    # a block scalar: the value is the next line
    block = re.compile(r"[|>][+-]?\d?").match(text, at)
    if a.group("op") == ":" and block and (n := _NEXT_LINE.match(text, block.end())):
        if lit := _literal(text, n.end()):
            yield lit[0], lit[1], True
        return
    if lit := _literal(text, at, before.endswith(("?", "&"))):
        tight = a.group("op") == "=" and a.group(0) == "="
        yield lit[0], lit[1], lit[2] or (tight and bool(re.search(r"\d", text[lit[0] : lit[1]])))


def _unescaped(text: str) -> tuple[str, list[int] | None]:
    """The text with ``\\uXXXX`` read, and the place of each of its characters in the original; None where nothing is escaped."""
    if "\\u" not in text:
        return text, None
    parts, place, at = [], [], 0
    for m in re.finditer(r"\\u([0-9a-fA-F]{4})", text):
        parts += [text[at : m.start()], chr(int(m.group(1), 16))]
        place += [*range(at, m.start()), m.start()]
        at = m.end()
    return "".join(parts) + text[at:], [*place, *range(at, len(text))]


#: What a name may be, as a sum: part of an issued token, named like a credential, a word of a rule, the head of a word of running text.
_MAY_ISSUE, _CREDENTIAL, _RULE, _CUE = 1, 2, 4, 8
_RULES = LOGIN_COMMANDS | TIGHT_COMMANDS | PASS_COMMANDS | USER_COMMANDS | LOGIN_CALLS | SERVER_WORDS | {"login", "Bearer", "Basic"}
_known: dict[str, int] = {}


def _kind_of(word: str) -> int:
    kind = _known.get(word)
    if kind is None:
        low = word.lower()
        kind = _MAY_ISSUE if len(word) >= 11 and word[0] != "-" else 0
        if _HINT.search(word) and credential_name(word.lstrip("-")):
            kind |= _CREDENTIAL
        if word in _RULES or low.endswith("authorization") or low in ("password", "identified"):
            kind |= _RULE
        if low.startswith(_FRONT) or low in _EXACT:
            kind |= _CUE
        if len(_known) > 200_000:
            _known.clear()
        if len(word) <= 80:  # long names, which may be any run of letters, aren't kept
            _known[word] = kind
    return kind


class _Reader:
    """One pass over a text: the credentials in code (``code``) and in running text (``prose``) go to ``found`` as (start, end, kind)."""

    def __init__(self, text: str, code: bool, prose: bool):
        self.text, self.code, self.prose = text, code, prose
        self.found: list[tuple[int, int, str]] = []
        # the end of the sentence, and where its next credential is (the text's length: there is none), so that no stretch is read twice
        self.reach = self.ahead = -1
        self.no_end = False

    def add(self, m: re.Match | None, kind: str, shape: str | None = None) -> None:
        if m and not stands_for_something(m.group("value"), True) and (shape is None or re.search(shape, m.group("value"))):
            self.found.append((m.start("value"), m.end("value"), kind))

    def run(self) -> list[tuple[int, int, str]]:
        text, at = self.text, 0
        command = caller = ""  # the command of the line so far, and the one that goes on over escaped line ends
        logged = False
        while at < len(text):
            for m in _TOKEN.finditer(text, at):
                kind = m.lastgroup
                if kind == "name":
                    word = m.group()
                    what = _kind_of(word)
                    if self.code and word[0] == "-" and (command or caller):
                        self.option(m.start(), word, command, caller, logged)
                    if not what:
                        continue
                    if what & _RULE and self.code:
                        if word in LOGIN_COMMANDS or word in TIGHT_COMMANDS or word in PASS_COMMANDS:
                            command, logged = word, False
                        elif word in USER_COMMANDS:
                            caller = word
                        elif word == "login":
                            logged = True
                        self.rule(word, m.start(), m.end())
                    if what & _MAY_ISSUE and self.code and (m.start() == 0 or text[m.start() - 1] not in "+/"):
                        token = _ISSUED.match(text, m.start())
                        if token and not stands_for_something(token.group(), True):
                            self.found.append((m.start(), token.end(), "issued token"))
                    if what & _CREDENTIAL and self.code:
                        self.named(m.end() - len(word.lstrip("-")), m.end())
                    if what & _CUE and self.prose:
                        self.cue(_PROSE.match(text, m.start()))
                elif kind == "line":
                    if m.start() == 0 or text[m.start() - 1] != "\\":
                        command = ""
                        caller = caller if m.group()[0] == "\\" else ""
                elif kind == "link":
                    if self.code and m.start() and text[m.start() - 1].isalnum():
                        self.add(_USER.match(text, m.end()), "url password")
                elif kind == "colon":
                    if self.code and (p := _PGPASS.match(text, m.start())):
                        self.pgpass(m.start(), p)
                elif kind == "foreign":
                    if self.prose:
                        for cue in _FOREIGN.finditer(text, m.start(), m.end() + _LONGEST):
                            if cue.start() < m.end() and (cue.start() == 0 or text[cue.start() - 1] not in "._$/-" and not (text[cue.start() - 1].isascii() and text[cue.start() - 1].isalnum()) or text[cue.start() - 2 : cue.start()] in ("\\n", "\\t", "\\r")):
                                self.cue(cue)
                elif kind == "block":
                    at = self.block(m)
                    break
            else:
                break
        return self.found

    def block(self, m: re.Match) -> int:
        """A key block, a certificate or a public key: where it ends. Only private keys are credentials."""
        stop = None if self.no_end else _BLOCK_END.search(self.text, m.end())
        self.no_end = stop is None
        end = stop.end() if stop else len(self.text)
        if self.code and _BLOCK.match(self.text, m.start()):
            body = re.sub(r"\\n|\s", "", self.text[m.end() : stop.start() if stop else end])
            if len(body) >= 16 and not stands_for_something(body, True):
                self.found.append((m.start(), end, "private key"))
        return end

    def option(self, start: int, word: str, command: str, caller: str, logged: bool) -> None:
        """An option of a command that takes a password."""
        text = self.text
        if caller and word in USER_OPTIONS and text[start - 1 : start].isspace():
            self.add(_OPTION_USER.match(text, start + len(word)), "login")
        if command and word.startswith("-p") and text[start - 1 : start].isspace():
            if command in PASS_COMMANDS:
                self.add(_OPTION_WIDE.match(text, start + 2), "login")
            elif command in TIGHT_COMMANDS:
                self.add(_OPTION_TIGHT.match(text, start + 2), "login")
            elif logged:
                self.add(_OPTION.match(text, start + 2), "login")

    def rule(self, word: str, start: int, end: int) -> None:
        """A word that passes a value in another way than by an operator."""
        text, low = self.text, word.lower()
        if low.endswith("authorization"):
            self.add(_SCHEME_AFTER.match(text, end), "authorization", r"\d|[A-Z].*[a-z]|=")
        elif word in ("Bearer", "Basic"):
            self.add(_SCHEME.match(text, end), "authorization", r"\d|[A-Z].*[a-z]|=")
        elif low == "identified":
            self.add(_IDENTIFIED.match(text, end), "login")
        elif low == "password":
            self.add(_SQL_PASSWORD.match(text, end), "login")
        elif word in SERVER_WORDS:
            self.add(_SERVER.match(text, end), "login")
        if word in LOGIN_CALLS:
            self.add(_ARGUMENT.match(text, end), "login")
            if word == "login":
                self.add(_MACHINE.match(text, end), "login")

    def pgpass(self, colon: int, m: re.Match) -> None:
        """host:port:database:user:value, where the host is no part of a link or an address."""
        text, start = self.text, colon
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.*-"):
            start -= 1
        if start < colon and (start == 0 or text[start - 1] not in "/:@"):
            self.add(m, "login")

    def named(self, start: int, end: int) -> None:
        """The literals that a credential-named identifier gets."""
        text, name = self.text, self.text[start:end]
        for a, b, quoted in _assigned(text, start, end):
            value = text[a:b]
            scheme = re.match(r"(?:Bearer|Basic|Token)\s+", value)
            if scheme:
                a, value = a + scheme.end(), value[scheme.end() :]
            value = value.strip() if quoted else value
            if a >= b or "\n" in value or value.startswith("-----BEGIN") or stands_for_something(value, quoted):
                continue
            if len(re.findall(r"(?:\s|\\[nrt])+", value)) >= RUNNING_WORDS:
                continue
            if name.lower() == "auth" and not re.fullmatch(r"[A-Za-z0-9+/_=.-]{12,}", value):
                continue
            self.found.append((a, b, "assigned"))

    def cue(self, m: re.Match | None) -> None:
        """The credential that a word of running text announces: the next word of the sentence that can be no ordinary one."""
        text = self.text
        if not m or _ASSIGNS.match(text, m.end()):
            return  # an assignment is read as code
        if m.end() > self.reach:
            stop = _SENTENCE_END.search(text, m.end())
            self.reach, self.ahead = stop.start() if stop else len(text), -1
        for t in _PROSE_TOKEN.finditer(text, m.end(), self.reach):
            word = t.group(0).rstrip(".:!?")
            bare = re.match(r"[\x21-\x7e]{8,}", word) or re.search(r"(?<=[^\x00-\x7f])[\x21-\x7e]{8,}", word)
            if bare and looks_secret(bare.group(0)):
                a, b = t.start() + bare.start(), t.start() + bare.end()
                self.found.append((a, b, "in text"))
                self.ahead = a
                return
            if self.ahead >= m.end():
                return
        self.ahead = len(text)


def find_credentials(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential's bare value, from 0, in order and without overlaps. Null gives none."""
    if not text:
        return []
    plain, place = _unescaped(text)
    if place is None:
        found = _Reader(text, True, True).run()
    else:  # running text is read with its escaped letters
        found = _Reader(text, True, False).run()
        found += [(place[a], place[b - 1] + 1, kind) for a, b, kind in _Reader(plain, False, True).run()]
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


def redact(text: str | None, mask: str = MASK) -> str | None:
    """The text with the content of each credential replaced; everything else, quotes and escapes too, is as before."""
    if not text:
        return text
    parts, at = [], 0
    for a, b, _ in find_credentials(text):
        parts += [text[at:a], mask]
        at = b
    return "".join(parts) + text[at:]


#: What a text with any credential must hold, compared without letter case in every script: checked in the JVM before a text goes to
#: Python. It is made of the lexer's own lists, and of a part of each rule that every match of it holds.
TRIGGERS = "(?iu)" + "|".join(
    (
        HINTS.replace("pw(?![a-z])", "pw"),
        r"login|bearer|basic|identified|BEGIN |://|:(?:\p{Nd}{2,5}|\*):|\\u[0-9a-f]{4}",
        *(w + r"\(" for w in sorted(LOGIN_CALLS) if not re.search(HINTS, w, re.I)),
        *sorted(TIGHT_COMMANDS),
        "(?:" + "|".join(sorted(USER_COMMANDS)) + r")\b[^\n]*?(?:" + "|".join(sorted(USER_OPTIONS)) + ")[ =]",
        *ISSUED,
        PROSE_WORDS,
    )
)


def credentials(items: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``items`` and credential: the other columns, ``start_pos`` (characters from 1), ``end_pos`` and ``kind``.

    Null and empty texts have none. Rows are processed on their own, whole, wherever they lie; no shuffle.
    """
    others = [c for c in items.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema if f.name != text) + ", start_pos int, end_pos int, kind string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, a + 1, b, kind) for k, t in enumerate(p[text]) for a, b, kind in find_credentials(t)]
            hits = pd.DataFrame(rows, columns=["_k", "start_pos", "end_pos", "kind"])
            yield pd.concat([p[others].iloc[hits["_k"]].reset_index(drop=True), hits.drop(columns="_k")], axis=1)

    return items.where(F.col(text).rlike(TRIGGERS)).mapInPandas(run, schema)


def redacted(column: Column | str) -> Column:
    """A column with its credentials masked; texts without a trigger don't leave the JVM's result unchanged."""
    c = F.col(column) if isinstance(column, str) else column

    @F.pandas_udf("string")
    def mask(s: pd.Series) -> pd.Series:
        return s.map(redact, na_action="ignore")

    return mask(c)
