"""Postal codes against the rules written out in Python."""

import random
import re

from scanweave import constants as K
from scanweave.functions import pin


def digits_of(token, table):
    return re.sub("[^0-9]", "", token.translate(str.maketrans(*table)))


def by_lane(separators, digits):
    found = digits_of(digits, K.PIN_WEAK)
    if sum(c in K.PIN_SEPARATORS for c in separators) * 5 >= len(separators) * 3 and len(digits) >= 6 and len(found) >= 6:
        return found[:6]


def by_rules(text):
    upper = text.upper()
    compact = re.sub(r"[^A-Z0-9|!]", "", upper)
    if len(compact) >= 10:
        even, odd = compact[::2], compact[1::2]
        lane = by_lane(even, odd) or by_lane(odd, even)
        if lane:
            return lane
    for token in re.findall(r"[A-Z0-9|!]{6,}", upper):
        strong, weak = digits_of(token, K.PIN_STRONG), digits_of(token, K.PIN_WEAK)
        if len(strong) == 6:
            return strong
        if len(strong) > 6 and re.fullmatch("[0-9]+", token):
            return strong[:6]
        if len(weak) == 6:
            return weak
    joined = re.sub("[^0-9]", "", upper)
    return joined[:6] if len(joined) >= 6 else ""


def test_lanes_with_just_enough_separators(values):
    """Separators in one lane only, from none to all of it, in texts of 8 to 17 symbols."""
    rng = random.Random(3)
    texts = ["ISL6LTL2ITLO", "56L210", "PIN CODE 560001", "", "A!1|2!3|4!5|6", "no code here at all"]
    for _ in range(3000):
        n, at = rng.randint(8, 17), rng.randint(0, 1)
        share = rng.choice([0.0, 0.4, 0.6, 0.8, 1.0])
        text = "".join(rng.choice("IL|!") if i % 2 == at and rng.random() < share else rng.choice("0123456789OSBAE") for i in range(n))
        texts.append(text if rng.random() < 0.7 else text[:4] + rng.choice(" -é") + text[4:])
    assert values(pin.pin_digits, [(t,) for t in texts], "t string") == [by_rules(t) for t in texts]
