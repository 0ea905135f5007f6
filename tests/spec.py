"""Byte-level specifications that the Spark plans are held against."""

VOWELS = b"aeiou"


class Porter:
    """Porter's algorithm, letter by letter over bytes."""

    def __init__(self, word: bytes):
        self.b = bytearray(word)

    def cons(self, i):
        c = self.b[i]
        if c in VOWELS:
            return False
        if c == ord("y"):
            return i == 0 or not self.cons(i - 1)
        return True

    def m(self, n):
        kinds = "".join("c" if self.cons(i) else "v" for i in range(n))
        while "cc" in kinds or "vv" in kinds:
            kinds = kinds.replace("cc", "c").replace("vv", "v")
        return kinds.count("vc")

    def vowel(self, n):
        return any(not self.cons(i) for i in range(n))

    def double(self):
        b = self.b
        return len(b) > 1 and b[-1] == b[-2] and self.cons(len(b) - 1)

    def cvc(self, n):
        return n >= 3 and self.cons(n - 1) and not self.cons(n - 2) and self.cons(n - 3) and self.b[n - 1] not in b"wxy"

    def ends(self, s):
        return self.b.endswith(s)

    def swap(self, s, new):
        self.b = self.b[: len(self.b) - len(s)] + new

    def run(self) -> bytes:
        if len(self.b) <= 2:
            return bytes(self.b)
        if self.ends(b"s"):
            if self.ends(b"sses"):
                self.swap(b"es", b"")
            elif self.ends(b"ies"):
                self.swap(b"ies", b"i")
            elif not self.ends(b"ss"):
                self.swap(b"s", b"")
        if self.ends(b"eed"):
            if self.m(len(self.b) - 3) > 0:
                self.swap(b"d", b"")
        else:
            for s in (b"ed", b"ing"):
                if self.ends(s):
                    if self.vowel(len(self.b) - len(s)):
                        self.swap(s, b"")
                        if self.ends(b"at") or self.ends(b"bl") or self.ends(b"iz"):
                            self.b += b"e"
                        elif self.double():
                            if self.b[-1] not in b"lsz":
                                self.b = self.b[:-1]
                        elif self.m(len(self.b)) == 1 and self.cvc(len(self.b)):
                            self.b += b"e"
                    break
        if len(self.b) <= 1:
            return bytes(self.b)
        if self.ends(b"y") and self.vowel(len(self.b) - 1):
            self.b[-1] = ord("i")
        for table in (
            "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log",
            "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:",
        ):
            for s, new in (x.encode().split(b":") for x in table.split(" ")):
                if self.ends(s):
                    if self.m(len(self.b) - len(s)) > 0:
                        self.swap(s, new)
                    break
        for s in b"al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split():
            if self.ends(s):
                if s == b"ion" and self.b[-4:-3] not in (b"s", b"t"):
                    continue
                if self.m(len(self.b) - len(s)) > 1:
                    self.swap(s, b"")
                break
        n = len(self.b)
        if self.ends(b"e"):
            m = self.m(n - 1)
            if m > 1 or (m == 1 and not self.cvc(n - 1)):
                self.b = self.b[:-1]
        if self.ends(b"ll") and self.m(len(self.b)) > 1:
            self.b = self.b[:-1]
        return bytes(self.b)


def stem(word: str) -> str:
    return Porter(word.encode()).run().decode("utf-8", "replace")


def is_word(c: int) -> bool:
    return c >= 128 or chr(c).isalnum()


def tokens(text: str, math: bool = False) -> list[str]:
    """The tokeniser as a scan over bytes."""
    b, out, i = text.encode(), [], 0
    while i < len(b):
        if math and b[i] == ord("#"):
            j = i + 1
            close = {ord("{"): ord("}"), ord("("): ord(")"), ord("!"): ord("!")}.get(b[j] if j < len(b) else 0)
            end = j
            while end < len(b) and b[end] not in b"\0 \t\r\n#":
                end += 1
            if close and end - j >= 3 and b[end - 1] == close and b[end : end + 1] == b"#" and b[end + 1 : end + 2] in (b"", b" ", b"\n"):
                out.append(b[i : end + 1].decode())
                i = end + 1
                continue
            i += 1
        elif is_word(b[i]):
            j = i
            while j < len(b) and is_word(b[j]):
                j += 1
            out.append(bytes(c + 32 if 65 <= c <= 90 else c for c in b[i:j]).decode())
            i = j + 1
        else:
            i += 1
    return out


def strip(text: str) -> str:
    """Markup removal as a scan."""
    low, out, i = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text), [], 0
    space = " \t\n\x0b\f\r"
    while i < len(text):
        if text[i] == "<":
            if text.startswith("<!--", i):
                j = text.find("-->", i + 4)
                i = len(text) if j < 0 else j + 3
            elif low.startswith("<script", i) or low.startswith("<style", i):
                tag = "</script>" if low.startswith("<script", i) else "</style>"
                j = low.find(tag, i + len(tag) - 2)
                i = len(text) if j < 0 else j + len(tag)
            else:
                j = text.find(">", i + 1)
                i = len(text) if j < 0 else j + 1
            out.append(" ")
        elif text[i] == "&":
            j = i + 1
            while j < len(text) and text[j] != ";" and text[j] not in space:
                j += 1
            if j < len(text) and text[j] == ";":
                out.append(" ")
                i = j + 1
            else:
                out.append("&")
                i += 1
        else:
            out.append(text[i])
            i += 1
    s, final, i = "".join(out), [], 0
    while i < len(s):
        if s[i] in space:
            j = i
            while j < len(s) and s[j] in space:
                j += 1
            if j < len(s):
                final.append("\n" if "\n" in s[i:j] else " ")
            i = j
        else:
            final.append(s[i])
            i += 1
    return "".join(final)
