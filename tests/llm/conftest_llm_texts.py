"""Made-up labelled texts: bad ones are set in marks, toxic ones hold insults with variants of spelling."""

import random


def labelled_texts(rng: random.Random, n: int):
    common = ["the", "house", "table", "river", "walks", "under", "seven", "bright", "mountain", "letter", "quiet", "answer"]
    insults = ["grubbleworm", "snorkhead", "vilefritz"]
    rows, labels = [], []
    for k in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        w = [rng.choice(common) for _ in range(rng.randint(30, 120))]
        if not good:
            w = [x + rng.choice(["###", "***", "$$$"]) for x in w]
        if toxic:
            for _ in range(6):
                x = rng.choice(insults)
                w[rng.randrange(len(w))] = x if rng.random() < 0.6 else x[:-2] + rng.choice(["st", "xx", "d"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(good), int(toxic)))
    return rows, labels
