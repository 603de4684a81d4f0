"""Labelled candidates for the personal-data model.

Sentences are written with personal data, and with other things that look alike, planted
in them at known places; formats, contexts and noise are those of the writers below and not of
the generators. The generators are then run over the sentences: what they propose is an
example, positive if it lies on planted personal data. So the model is fitted, and its thresholds
are calibrated, on what generators find, with true text on both sides.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from typing import NamedTuple


class Example(NamedTuple):
    kind: str
    text: str
    left: str
    right: str
    label: int


def _of(r: random.Random, alphabet: str, n: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(n))


DIGITS, HEX = "0123456789", "0123456789abcdef"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _shaped(r: random.Random, shape: str) -> str:
    """The shape with digits for #, capitals for @, letters or digits for *, hexadecimal digits for ~, capitals or digits for ^, letters, digits, / or + for |, small letters for ?, and the check digits of an account number for %%."""
    alphabets = {"#": DIGITS, "@": LETTERS[:26], "*": LETTERS + DIGITS, "~": HEX, "^": LETTERS[:26] + DIGITS, "|": LETTERS + DIGITS + "/+", "?": LETTERS[26:]}
    made = "".join(r.choice(alphabets[c]) if c in alphabets else c for c in shape)
    if "%%" in made:
        plain = made.replace(" ", "")
        made = made.replace("%%", f"{98 - int(''.join(str(int(c, 36)) for c in plain[4:] + plain[:2] + '00')) % 97:02d}")
    return made


# How personal data of each kind is written, what stands before or behind it, and the same for what only looks like it.
PERSONAL: dict[str, tuple[list[str], list[str], list[str]]] = {
    "secret": (["~" * 40, "*" * 24, "*" * 32, "*" * 40, "sk-" + "*" * 32, "ghp_" + "*" * 36, "*" * 16 + "_" + "*" * 20], ['token = "', "api_key: ", "password=", "the secret is ", "access key ", 'TOKEN = "', "apikey=", "bearer ", "key ", "credential: "], [" is my api key", '" as the token', " (secret)", "", "", ""]),
    "ssn": (["###-##-####"], ["ssn ", "social security number: ", "my ssn is ", "social security no. ", "taxpayer id "], [" is my ssn", " (social security)", "", "", "", ""]),
    "iban": (["DE####################", "FR## #####".replace(" ", "") + "#" * 18, "GB##@@@@" + "#" * 14, "ES" + "#" * 22, "DE%%##################", "DE%% #### #### #### #### ##", "GB%% @@@@ #### #### #### ##", "FR%% #### #### #### #### #### ###", "NL%%@@@@##########", "AT%% #### #### #### ####"], ["iban ", "bank account: ", "pay to ", "konto ", "account number ", "transfer to "], [" is my iban", " at the bank", "", "", ""]),
    "birth": (["19##-0#-1#", "1#/0#/19##", "2#.0#.20##", "0#/2#/19##"], ["born on ", "date of birth: ", "dob ", "birthday ", "geboren am ", "born ", "birth date "], [" is my birthday", " (date of birth)", "", "", ""]),
    "local_phone": (["(###) ###-####", "###-###-####", "0### ######", "### ### ####", "0##/#######".replace("/", "-")], ["call ", "phone: ", "tel. ", "mobile ", "telephone ", "fax ", "call me at ", "my phone number is "], [" is my phone", " (mobile)", "", "", ""]),
    "spelled_email": (["jane at example dot com", "bob.s [at] mail5 [dot] com", "k_weber(at)acme(dot)org", "luis at acme dot net", "ann [at] example dot io", "tom.b at firma dot de", "??? at ???? dot com", "???? at ???? dot org", "?????.? at ?????? dot com", "??? [at] ????# [dot] net", "?_?????(at)????(dot)org", "???? at ??????? dot io"], ["mail me: ", "e-mail ", "contact ", "write to ", "email: "], [" for mail", "", "", ""]),
    "known_key": (["AKIA" + "^" * 16, "ASIA" + "^" * 16, "AKIA" + "@" * 7 + "#" + "@" * 8, "AKIA" + "@" * 3 + "##" + "@" * 11, "AIza" + "*" * 35, "ghp_" + "*" * 36, "gho_" + "*" * 36, "xoxb-" + "#" * 12 + "-" + "*" * 24, "glpat-" + "*" * 20, "sk_live_" + "*" * 24, "eyJ" + "*" * 20 + ".eyJ" + "*" * 40 + "." + "*" * 43, "eyJ" + "*" * 33 + ".eyJ" + "*" * 60, "-----BEGIN RSA PRIVATE KEY-----"], ["token ", "key ", "access key id ", "aws_access_key_id = ", "bearer ", "the ", "use ", "set ", ""], [" is the key", " (key)", "", "", ""]),
    "base64_key": (["|" * 40, "*" * 8 + "/" + "*" * 12 + "+" + "*" * 18, "*" * 12 + "/*******/" + "*" * 18, "*" * 20 + "+" + "*" * 22 + "=", "*" * 15 + "/" + "*" * 26 + "=="], ["secret ", "secret key: ", "aws_secret_access_key = ", 'key = "', "password: ", "token ", "credential: "], [" is my secret", '" as the key', "", "", ""]),
    "identity": (["C##@##@##", "@########", "@@#######", "##@@#####", "@^^^^^^##", "L#@#@#@##"], ["passport number ", "passport no. ", "passport: ", "identity card ", "id card no. ", "my passport is ", "passport "], [" is my passport", " (passport)", "", "", ""]),
    "password": (["hunter#", "Correct#Horse", "s3cr#t!pw", "letmein##", "*******", "**********", "P@ssw0rd##", "qwerty###", "sommer20##"], ["password is ", "my password is ", "password: ", "password=", "passwd: ", "passwort ist ", "pwd: ", "the password is "], ["", "", ""]),
}
OTHER: dict[str, tuple[list[str], list[str], list[str]]] = {
    "secret": (["~" * 40, "internationalisation_of_part#", "section-##-of-the-handbook", "aaaaaaaaaaaa#########", "0" * 22, "~" * 64, "lib-very-long-name-v#", "#" * 24], ["commit ", "see file ", "checksum ", "class ", "variable ", "the ", "sha256 ", "build ", "version "], [" is the commit", " (checksum)", " was merged", "", ""]),
    "ssn": (["###-##-####"], ["part no. ", "order ", "isbn ", "invoice ", "version ", "ref ", "the ", "page "], [" is the part", " (order)", " pieces", "", ""]),
    "iban": (["DE## @@@@ @@@@ @@@@ @@@@", "SN## #### #### ####", "XX## @#@# @#@# @#@#", "PN##@@@@@@@@@@@", "SN##" + "#" * 14, "XX##@#@#@#@#@#@#", "DE##@@@@@@@@@@@@"], ["model ", "serial ", "code ", "part no. ", "the ", "version "], [" is the serial", " (model)", "", ""]),
    "birth": (["20##-0#-1#", "1#/0#/19##", "2#.0#.20##", "####-##-##"], ["released on ", "version ", "meeting on ", "the ", "updated ", "on ", "due ", "figure "], [" was the release", " (version)", "", ""]),
    "local_phone": (["#########", "###-###-####", "## ## ## ##", "################", "########"], ["order ", "isbn ", "total ", "the ", "invoice ", "item ", "page ", "ref "], [" items", " is the order", " (isbn)", "", ""]),
    "spelled_email": (["home at night dot then", "once at noon dot and", "him at last dot so", "good at chess dot so"], ["we met ", "look ", "arrive ", "the ", "laugh ", "stay "], [" we left", "", ""]),
    "known_key": (["AKIA" + "@" * 16, "xoxo-and-so-on-for-ever", "AROA" + "A" * 16, "ghs_" + "a" * 24], ["the town of ", "in ", "page ", "figure "], [" was there", " items", "", ""]),
    "base64_key": (["path/to/some/file#", "src/main/java/module#/util", "home/user/docs/report20##", "left/right/up/down/#/#", "and/or/not/xor/nand#", "usr/local/lib/python3/site"], ["see ", "open ", "the file ", "in ", "under ", "path "], [" is the path", " was moved", "", "", ""]),
    "identity": (["A4B5C6D7", "ISO9001X#", "HTTP2TLS13", "UTF8BOM16", "@@#######", "##@@#####", "MODEL##X#"], ["model ", "part no. ", "order ", "version ", "serial ", "the ", "code "], [" is the model", " (part)", " items", "", ""]),
    "password": (["required", "not-set", "changed", "optional", "missing", "stored", "hashed", "expired", "invalid"], ["password is ", "the password is ", "your password is "], ["", " here", " and sent by mail"]),
}
#: Of kinds that their own characters prove, what they are where nothing near says so.
PROVEN: dict[str, tuple[list[str], list[str], list[str]]] = {
    kind: ([s for s in PERSONAL[kind][0] if kind != "iban" or "%%" in s], ["we use ", "it was ", "see ", "and ", "then ", "with "], [" for rent", " and more", " here", "", ""]) for kind in ("iban", "known_key")
}
FILLERS = ["and so it was. ", "lorem ipsum dolor ", "Der die das ", "\n", "We have seen 3 of 12. ", "la que el en ", "x = 1; ", "(note) "]


def examples(generators: dict[str, str], per_kind: int = 160, seed: int = 20, context: int = 40) -> list[Example]:
    """Candidates of the generators (kind -> pattern) over per_kind sentences of each sort; reruns agree."""
    r, out = random.Random(seed), []
    near: Callable[[tuple[int, int], tuple[int, int]], bool] = lambda a, b: 2 * (min(a[1], b[1]) - max(a[0], b[0])) >= max(a[1], b[1]) - min(a[0], b[0])
    for kind in PERSONAL:
        for source, personal in ((PERSONAL, True), (OTHER, False), (PROVEN, True)):
            if kind not in source:
                continue
            shapes, lefts, rights = source[kind]
            for _ in range(per_kind):
                right = r.choice(rights)
                left = r.choice(lefts) if not right or r.random() < 0.7 else ""
                span = _shaped(r, r.choice(shapes))
                start = "".join(r.choice(FILLERS) for _ in range(r.randint(0, 2))) + left
                text = start + span + right + r.choice([". ", '" ', "\n", ", and ", " "]) + r.choice(FILLERS)
                place = (len(start), len(start) + len(span))
                for name, pattern in generators.items():
                    for m in re.finditer(pattern, text):
                        hit = personal and name == kind and near(m.span(), place)
                        if hit or name == kind or not near(m.span(), place):
                            out.append(Example(name, m.group(), text[max(0, m.start() - context) : m.start()], text[m.end() : m.end() + context], int(hit)))
    return out
