"""A model over bytes that writes the same two sentences again and again."""

import numpy as np

TEXT = b"One went home. Two came late. "


class Toy:
    def __init__(self, sharpness):
        self.sharpness = sharpness

    def encode(self, text):
        return list(text.encode())

    def decode(self, ids):
        return bytes(ids).decode("latin-1")

    def logits(self, ids):
        out = np.zeros((len(ids), 256))
        out[np.arange(len(ids)), [TEXT[(i + 1) % len(TEXT)] for i in range(len(ids))]] = self.sharpness
        return out


def load():
    return Toy(20.0), Toy(10.0)


def load_one():
    return Toy(20.0), None
