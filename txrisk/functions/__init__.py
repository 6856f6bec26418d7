from .columns import (  # noqa: F401
    clip_probability,
    encode_type,
    f32,
    flag,
    lit_f32,
    money,
    pseudonym,
    ratio_or_zero,
    safe_divide,
)
