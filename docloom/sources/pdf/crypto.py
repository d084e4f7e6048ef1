"""The standard security handler, revisions 2 to 6. AES is here because neither Python nor Spark has CBC without padding."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass
from typing import Any

# Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _sbox() -> tuple[bytes, bytes]:
    """From its rule: inverses in GF(2**8), then an affine map."""
    box, p, q = [0] * 256, 1, 1
    while True:
        p ^= (p << 1) ^ (0x11B if p & 0x80 else 0)
        p &= 0xFF
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q &= 0xFF
        q ^= 0x09 if q & 0x80 else 0
        turn = lambda n, q=q: (q << n | q >> (8 - n)) & 0xFF
        box[p] = q ^ turn(1) ^ turn(2) ^ turn(3) ^ turn(4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


SBOX, INVERSE = _sbox()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


_MUL = {k: bytes(_times(i, k) for i in range(256)) for k in (2, 3, 9, 11, 13, 14)}
_SHIFT = [0, 5, 10, 15, 4, 9, 14, 3, 8, 13, 2, 7, 12, 1, 6, 11]
_UNSHIFT = [_SHIFT.index(i) for i in range(16)]


#: Of each byte through the box, its column after mixing, in each of four rows.
_ROUND = [[int.from_bytes(bytes(m[(i - row) % 4] for i in range(4)), "big") for s in SBOX for m in [(_MUL[2][s], s, s, _MUL[3][s])]] for row in range(4)]


class AES:
    def __init__(self, key: bytes):
        n, words, power = len(key) // 4, [key[i : i + 4] for i in range(0, len(key), 4)], 1
        rounds = n + 6
        for i in range(n, 4 * (rounds + 1)):
            w = words[-1]
            if i % n == 0:
                w = bytes([SBOX[w[1]] ^ power, SBOX[w[2]], SBOX[w[3]], SBOX[w[0]]])
                power = _times(power, 2)
            elif n > 6 and i % n == 4:
                w = w.translate(SBOX)
            words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
        self.keys = [b"".join(words[4 * r : 4 * r + 4]) for r in range(rounds + 1)]
        self.words = [int.from_bytes(w, "big") for w in words]

    def encrypt(self, block: bytes) -> bytes:
        """A round takes four lookups a column: a table has the box and the mixing of a row in one."""
        t0, t1, t2, t3 = _ROUND
        k = self.words
        a, b, c, d = (int.from_bytes(block[i : i + 4], "big") ^ k[i >> 2] for i in (0, 4, 8, 12))
        for r in range(4, len(k) - 4, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[r],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[r + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[r + 2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[r + 3],
            )
        s = SBOX
        last = bytes((s[a >> 24], s[b >> 16 & 255], s[c >> 8 & 255], s[d & 255], s[b >> 24], s[c >> 16 & 255], s[d >> 8 & 255], s[a & 255], s[c >> 24], s[d >> 16 & 255], s[a >> 8 & 255], s[b & 255], s[d >> 24], s[a >> 16 & 255], s[b >> 8 & 255], s[c & 255]))
        return (int.from_bytes(last, "big") ^ int.from_bytes(self.keys[-1], "big")).to_bytes(16, "big")

    def decrypt(self, block: bytes) -> bytes:
        m9, m11, m13, m14 = (_MUL[k] for k in (9, 11, 13, 14))
        s = bytes(a ^ b for a, b in zip(block, self.keys[-1], strict=True))
        for r in range(len(self.keys) - 2, -1, -1):
            s = bytes([s[i] for i in _UNSHIFT]).translate(INVERSE)
            s = bytes(a ^ b for a, b in zip(s, self.keys[r], strict=True))
            if r:
                s = bytes(x for c in range(0, 16, 4) for x in (m14[s[c]] ^ m11[s[c + 1]] ^ m13[s[c + 2]] ^ m9[s[c + 3]], m9[s[c]] ^ m14[s[c + 1]] ^ m11[s[c + 2]] ^ m13[s[c + 3]], m13[s[c]] ^ m9[s[c + 1]] ^ m14[s[c + 2]] ^ m11[s[c + 3]], m11[s[c]] ^ m13[s[c + 1]] ^ m9[s[c + 2]] ^ m14[s[c + 3]]))
        return s


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, out = AES(key), bytearray()
    for i in range(0, len(data), 16):
        iv = aes.encrypt((int.from_bytes(data[i : i + 16], "big") ^ int.from_bytes(iv, "big")).to_bytes(16, "big"))
        out += iv
    return bytes(out)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks only; no padding is taken off."""
    aes, out = AES(key), bytearray()
    for i in range(0, len(data) // 16 * 16, 16):
        block = data[i : i + 16]
        out += bytes(a ^ b for a, b in zip(aes.decrypt(block), iv, strict=True))
        iv = block
    return bytes(out)


def cbc_decrypt_prefixed(key: bytes, data: bytes) -> bytes:
    """The first block is the IV; padding that isn't right stays."""
    out = cbc_decrypt(key, data[:16], data[16:])
    n = out[-1] if out else 0
    return out[:-n] if 1 <= n <= 16 and out[-n:] == bytes([n]) * n else out


def cbc_encrypt_prefixed(key: bytes, iv: bytes, plain: bytes) -> bytes:
    n = 16 - len(plain) % 16
    return iv + cbc_encrypt(key, iv, plain + bytes([n]) * n)


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray()
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def hash_r6(password: bytes, salt: bytes, extra: bytes = b"", revision: int = 6) -> bytes:
    k = hashlib.sha256(password + salt + extra).digest()
    if revision < 6:
        return k
    n = 0
    while True:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


@dataclass
class Handler:
    """An encryption dictionary, and the file key once a password fits."""

    version: int
    revision: int
    length: int
    o: bytes
    u: bytes
    oe: bytes
    ue: bytes
    permissions: int
    file_id: bytes
    encrypt_metadata: bool
    stream_method: str
    string_method: str
    key: bytes | None = None
    level: str = "none"

    @classmethod
    def of(cls, d: dict[str, Any], file_id: bytes) -> Handler | None:
        if d.get("Filter") != "Standard":
            return None
        num = lambda k, default: d[k] if isinstance(d.get(k), int) else default
        raw = lambda k: d[k] if isinstance(d.get(k), bytes) else b""
        version = num("V", 0)

        def method(which: str) -> str:
            if version < 4:
                return "V2"
            name = d.get(which, "Identity")
            found = (d.get("CF") or {}).get(name) if name != "Identity" else None
            return found.get("CFM", "None") if isinstance(found, dict) else "None"

        length = 40 if version == 1 else num("Length", 128 if version >= 4 else 40)
        return cls(version, num("R", 2), max(40, min(256, length)) // 8, raw("O"), raw("U"), raw("OE"), raw("UE"), num("P", 0), file_id, d.get("EncryptMetadata") is not False, method("StmF"), method("StrF"))

    def authenticate(self, password: str) -> str:
        """none, user or owner; the owner's password is tried first."""
        if self.revision >= 5:
            return self._authenticate_aes256(password.encode()[:127])
        raw = password.encode("latin-1", "replace")
        if (key := self._user_key(self._user_of_owner(raw))) is not None:
            self.key, self.level = key, "owner"
        elif (key := self._user_key(raw)) is not None:
            self.key, self.level = key, "user"
        return self.level

    def _owner_key(self, password: bytes) -> bytes:
        k = hashlib.md5((password + PAD)[:32]).digest()
        if self.revision >= 3:
            for _ in range(50):
                k = hashlib.md5(k).digest()
        return k[: self.length if self.revision >= 3 else 5]

    def _user_of_owner(self, password: bytes) -> bytes:
        k, out = self._owner_key(password), self.o[:32]
        for i in range(19 if self.revision >= 3 else 0, -1, -1):
            out = rc4(bytes(c ^ i for c in k), out)
        return out

    def file_key(self, password: bytes) -> bytes:
        k = hashlib.md5((password + PAD)[:32] + self.o[:32] + (self.permissions & 0xFFFFFFFF).to_bytes(4, "little") + self.file_id + (b"\xff" * 4 if self.revision >= 4 and not self.encrypt_metadata else b"")).digest()
        n = self.length if self.revision >= 3 else 5
        if self.revision >= 3:
            for _ in range(50):
                k = hashlib.md5(k[:n]).digest()
        return k[:n]

    def check_value(self, key: bytes) -> bytes:
        if self.revision < 3:
            return rc4(key, PAD)
        out = hashlib.md5(PAD + self.file_id).digest()
        for i in range(20):
            out = rc4(bytes(c ^ i for c in key), out)
        return out

    def _user_key(self, password: bytes) -> bytes | None:
        key = self.file_key(password)
        n = 32 if self.revision < 3 else 16
        return key if hmac.compare_digest(self.check_value(key)[:n], self.u[:n]) else None

    def _authenticate_aes256(self, password: bytes) -> str:
        for level, stored, extra, sealed in (("owner", self.o, self.u[:48], self.oe), ("user", self.u, b"", self.ue)):
            if len(stored) >= 48 and hmac.compare_digest(hash_r6(password, stored[32:40], extra, self.revision), stored[:32]):
                self.key = cbc_decrypt(hash_r6(password, stored[40:48], extra, self.revision), bytes(16), sealed[:32])
                self.level = level
                break
        return self.level

    def decrypt(self, data: bytes, num: int, gen: int, stream: bool) -> bytes:
        method = self.stream_method if stream else self.string_method
        if self.key is None or method in ("None", "Identity"):
            return data
        if method == "AESV3":
            return cbc_decrypt_prefixed(self.key, data)
        seed = self.key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if method == "AESV2" else b"")
        key = hashlib.md5(seed).digest()[: min(16, len(self.key) + 5)]
        return cbc_decrypt_prefixed(key, data) if method == "AESV2" else rc4(key, data)


def build_r6(user: str, owner: str, permissions: int, entropy: bytes) -> tuple[dict[str, Any], bytes]:
    """(encryption dictionary without crypt filters, file key) from 64 bytes of entropy."""
    key, salts = entropy[:32], [entropy[32 + 8 * i : 40 + 8 * i] for i in range(4)]

    def sealed(password: bytes, check: bytes, wrap: bytes, extra: bytes) -> tuple[bytes, bytes]:
        return hash_r6(password, check, extra) + check + wrap, cbc_encrypt(hash_r6(password, wrap, extra), bytes(16), key)

    u, ue = sealed(user.encode()[:127], salts[0], salts[1], b"")
    o, oe = sealed(owner.encode()[:127], salts[2], salts[3], u)
    perms = (permissions & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + key[:4]
    return {"Filter": "Standard", "V": 5, "R": 6, "Length": 256, "O": o, "U": u, "OE": oe, "UE": ue, "P": permissions, "Perms": AES(key).encrypt(perms)}, key
