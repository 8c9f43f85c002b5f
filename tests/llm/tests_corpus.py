import random


def rows():
    g = random.Random(4)
    word = lambda: "".join(g.choice(["ra", "to", "mi", "ne", "su", "ka"]) for _ in range(g.randint(2, 4)))
    text = lambda n: " ".join(word() + ("." if i % 8 == 7 else "") for i in range(n))
    out = [(i, text(120), "en", f"s{i % 3}") for i in range(20)]
    base = text(200)
    out += [(30 + i, base.replace(" ", " x ", i), "en", "s0") for i in range(4)]
    shared = text(60)
    out += [(40 + i, f"{text(60)} {shared} {text(60)}", "en", "s1") for i in range(3)]
    out.append((50, "same words again " * 40, "en", "s2"))
    return [(d, t, lang, s, len(t)) for d, t, lang, s in out]
