"""Texts that several tests use."""


def thue_morse(n):
    """Two words of ``n`` letters that any polynomial hash modulo 2 ** 64 takes for equal if n >= 1024."""
    first = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return first, first.translate(str.maketrans("ab", "ba"))
