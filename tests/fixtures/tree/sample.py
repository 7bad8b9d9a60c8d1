"""Module text."""
import os

LIMIT = 3


@cached
def load(path):
    """def fake(): pass"""
    return path


class Queue:
    def push(self, x):
        return x


@dataclass
class Item:
    name: str


async def fetch():
    return 1
