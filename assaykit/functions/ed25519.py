"""Ed25519 on Python integers, after RFC 8032. A small per-row helper for the signing jobs.

Uses the ``cryptography`` package instead where it is installed.
"""

from __future__ import annotations

import hashlib

try:
    from cryptography.hazmat.primitives.asymmetric import ed25519 as _native
    from cryptography.hazmat.primitives.serialization import Encoding, PublicFormat
except ImportError:
    _native = None

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)
IDENTITY = (0, 1, 1, 0)


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.sha512(data).digest(), "little")


def _add(p, q):
    a = (p[1] - p[0]) * (q[1] - q[0]) % P
    b = (p[1] + p[0]) * (q[1] + q[0]) % P
    c = 2 * p[3] * q[3] * D % P
    d = 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(scalar: int, point):
    total = IDENTITY
    while scalar:
        if scalar & 1:
            total = _add(total, point)
        point = _add(point, point)
        scalar >>= 1
    return total


def _same(p, q) -> bool:
    return (p[0] * q[2] - q[0] * p[2]) % P == 0 and (p[1] * q[2] - q[1] * p[2]) % P == 0


def _x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    if square == 0:
        return None if odd else 0
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P:
        return None
    return P - x if (x & 1) != odd else x


def _pack(point) -> bytes:
    inverse = pow(point[2], P - 2, P)
    x, y = point[0] * inverse % P, point[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes):
    raw = int.from_bytes(data, "little")
    y = raw & ((1 << 255) - 1)
    x = _x_of(y, raw >> 255)
    return None if x is None else (x, y, 1, x * y % P)


_BASE_Y = 4 * pow(5, P - 2, P) % P
_BASE_X = _x_of(_BASE_Y, 0)
BASE = (_BASE_X, _BASE_Y, 1, _BASE_X * _BASE_Y % P)


def _secret(seed: bytes) -> tuple[int, bytes]:
    half = hashlib.sha512(seed).digest()
    scalar = int.from_bytes(half[:32], "little")
    scalar = (scalar & ((1 << 254) - 8)) | (1 << 254)
    return scalar, half[32:]


def public_key(seed: bytes) -> bytes:
    if _native:
        key = _native.Ed25519PrivateKey.from_private_bytes(seed).public_key()
        return key.public_bytes(Encoding.Raw, PublicFormat.Raw)
    return _pack(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    if _native:
        return _native.Ed25519PrivateKey.from_private_bytes(seed).sign(message)
    scalar, prefix = _secret(seed)
    public = _pack(_times(scalar, BASE))
    r = _digest(prefix + message) % ORDER
    commitment = _pack(_times(r, BASE))
    challenge = _digest(commitment + public + message) % ORDER
    return commitment + ((r + challenge * scalar) % ORDER).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    if _native:
        try:
            _native.Ed25519PublicKey.from_public_bytes(public).verify(signature, message)
            return True
        except Exception:
            return False
    point, commitment = _unpack(public), _unpack(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if point is None or commitment is None or s >= ORDER:
        return False
    challenge = _digest(signature[:32] + public + message) % ORDER
    return _same(_times(s, BASE), _add(commitment, _times(challenge, point)))
