"""Decoders from packages that may not be installed, and from a command-line program.

Each is made where it runs; making one without its package raises ``ImportError`` with the package's name.
"""

from __future__ import annotations

import subprocess
import tempfile
from pathlib import Path

import numpy as np

from .decode import DECODERS
from .graph import Graph


def _need(package: str):
    try:
        return __import__(package)
    except ImportError as e:
        raise ImportError(f"this decoder needs the package {package}") from e


class External:
    """A decoder that is made again in every Python worker, from what it was made of."""

    quiet = None

    def __init__(self, *made_of):
        self.made_of = made_of
        self.inner = self.make(*made_of)

    def __reduce__(self):
        return type(self), self.made_of

    def make(self, *made_of):
        raise NotImplementedError

    def bits(self, active: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def decode(self, active: np.ndarray) -> tuple[int, float]:
        return sum(1 << i for i, b in enumerate(np.asarray(self.bits(active)).ravel()[:64]) if b), 1.0


class PyMatching(External):
    """Minimum-weight matching by the package of that name, from a graph."""

    def make(self, graph: Graph):
        matching = _need("pymatching").Matching()
        for u, v, w, m in zip(graph.u.tolist(), graph.v.tolist(), graph.weight.tolist(), graph.mask.tolist(), strict=True):
            ids = {i for i in range(64) if m >> i & 1}
            if graph.detectors in (u, v):
                matching.add_boundary_edge(min(u, v), weight=w, fault_ids=ids, merge_strategy="independent")
            else:
                matching.add_edge(u, v, weight=w, fault_ids=ids, merge_strategy="independent")
        return matching

    def bits(self, active: np.ndarray) -> np.ndarray:
        x = np.zeros(self.made_of[0].detectors, np.uint8)
        x[active] = 1
        return self.inner.decode(x)


class Chromobius(External):
    """Color-code decoding by the package of that name, from a model's text and its number of detectors."""

    def make(self, model_text: str, detectors: int):
        stim = _need("stim")
        return _need("chromobius").compile_decoder_for_dem(stim.DetectorErrorModel(model_text))

    def bits(self, active: np.ndarray) -> np.ndarray:
        x = np.zeros(self.made_of[1], np.uint8)
        x[active] = 1
        said = self.inner.predict_obs_flips_from_dets_bit_packed(np.packbits(x, bitorder="little")[None])
        return np.unpackbits(said[0], bitorder="little")


class Program(External):
    """A command-line decoder that reads packed detectors (least significant bit first) and writes packed observables."""

    def make(self, command: str, model_text: str, detectors: int, observables: int, timeout: float = 60):
        return command

    def bits(self, active: np.ndarray) -> np.ndarray:
        command, text, detectors, observables, *rest = self.made_of
        with tempfile.TemporaryDirectory() as at:
            x = np.zeros(detectors, np.uint8)
            x[active] = 1
            Path(at, "model.dem").write_text(text)
            Path(at, "in.b8").write_bytes(np.packbits(x, bitorder="little").tobytes())
            subprocess.run([command, "--dem", f"{at}/model.dem", "--in", f"{at}/in.b8", "--in-format", "b8", "--out", f"{at}/out.b8", "--out-format", "b8"], check=True, timeout=rest[0] if rest else 60)
            return np.unpackbits(np.frombuffer(Path(at, "out.b8").read_bytes(), np.uint8), bitorder="little")[:observables]


class Circuit:
    """Shots of a circuit from an external simulator with the usual ``detect`` command and lines of 0 and 1.

    ``draw`` has the form of ``sample.Sampler.draw``, so circuits can be sampled, written to files and served.
    """

    def __init__(self, command: str, text: str, timeout: float = 600):
        self.command, self.text, self.timeout = command, text, timeout

    @staticmethod
    def _lines(path: Path, n: int) -> np.ndarray:
        lines = path.read_text().split("\n")[:n]
        if len(lines) < n or len(set(map(len, lines))) > 1:
            raise ValueError(f"{path.name}: {n} lines of one length were asked for")
        return np.array([[c == "1" for c in line] for line in lines], bool).reshape(n, -1)

    def draw(self, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        with tempfile.TemporaryDirectory() as at:
            Path(at, "circuit").write_text(self.text)
            seed = str(int(rng.integers(1 << 62)))
            subprocess.run([self.command, "detect", "--shots", str(n), "--seed", seed, "--in", f"{at}/circuit", "--out", f"{at}/out", "--out_format", "01", "--obs_out", f"{at}/obs", "--obs_out_format", "01"], check=True, timeout=self.timeout)
            flips = self._lines(Path(at, "obs"), n)[:, :64].astype(np.uint64)
            return self._lines(Path(at, "out"), n), (flips << np.arange(flips.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


DECODERS["pymatching"] = PyMatching
