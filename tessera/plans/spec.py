"""Model programs: a list of operations with named inputs and one output each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

# kinds of operations
DEGREES, POWER, CONSTANT = "degrees", "power", "constant"
ROW_SCALE, AGGREGATE, FFN, ADD, EPS_SCALE, RELU = "row_scale", "aggregate", "ffn", "add", "eps_scale", "relu"
ATTEN, EDGE_SUM, EDGE_MUL, EDGE_DOT, LEAKY_RELU, SOFTMAX = "atten", "edge_sum", "edge_mul", "edge_dot", "leaky_relu", "softmax"

#: Sizes that only the data give.
OPEN_FEATURES, OPEN_LABELS = -2, -3

#: Linear in their vector input, so a dense layer without bias commutes with them.
LINEAR = {ROW_SCALE, AGGREGATE, ADD, EPS_SCALE}


@dataclass(frozen=True)
class Op:
    """``out = kind(inputs)``.  Vector inputs come last; ``weight`` names a
    parameter of in_dim x out_dim (1 x 1 and ``value`` at first for an epsilon); ``fn`` is an aggregate's function; ``hop`` is
    the receptive field that restricts an aggregate (0: the whole graph)."""

    kind: str
    inputs: tuple[str, ...]
    out: str
    weight: str | None = None
    in_dim: int | None = None
    out_dim: int | None = None
    value: float | None = None
    fn: str = "sum"
    bias: bool = False
    hop: int = 0
    invariant: bool = False


@dataclass(frozen=True)
class Schedule:
    """What a program's schedule lines ask for."""

    undirected: bool = True
    unweighted: bool = True
    feature_size: int | None = None
    label_size: int | None = None
    col_tile: int | None = None
    sparse: bool = False
    data_sample: int | None = None
    opt_input: str | None = None
    print_accuracy: bool = False
    print_memory: bool = False
    coarsen: int | None = None
    kernel_sample: int | None = None
    dynamic: bool = False
    reordering: bool = True
    sparse_rewrites: bool = True
    training_subgraph: bool = True
    code_motion: bool = True


@dataclass(frozen=True)
class ModelSpec:
    """A program: its operations, its result, and how to train and schedule it."""

    ops: tuple[Op, ...]
    result: str
    dataset: str = ""
    iterations: int = 0
    validation_step: int = 1
    evaluate: bool = False
    schedule: Schedule = field(default_factory=Schedule)

    def with_ops(self, ops: Sequence[Op]) -> ModelSpec:
        return replace(self, ops=tuple(ops))

    def weights(self) -> dict[str, tuple[int, int]]:
        """The shape of every parameter but biases."""
        return {op.weight: (op.in_dim, op.out_dim) for op in self.ops if op.weight and op.in_dim and op.out_dim}

    def biases(self) -> dict[str, str]:
        """The name of the bias of every dense layer that has one, by its weight."""
        return {op.weight: f"{op.weight}_bias" for op in self.ops if op.kind == FFN and op.bias}

    def biased(self) -> ModelSpec:
        """The program with a learnable bias in every dense layer."""
        return self.with_ops([replace(op, bias=True) if op.kind == FFN else op for op in self.ops])

    def sized(self, features: int, labels: int) -> ModelSpec:
        """The program with the sizes of its data in place of those left open."""
        size = {OPEN_FEATURES: features, OPEN_LABELS: labels}
        return self.with_ops([replace(op, in_dim=size.get(op.in_dim, op.in_dim), out_dim=size.get(op.out_dim, op.out_dim)) for op in self.ops])


class Builder:
    """Appends operations and names their outputs."""

    def __init__(self):
        self.ops: list[Op] = []

    def add(self, kind: str, *inputs: str, **how) -> str:
        out = how.pop("out", None) or f"t{len(self.ops)}"
        self.ops.append(Op(kind, inputs, out, **how))
        return out


def gcn(b: Builder, x: str, i: int, o: int, k: int, relu: bool, norm: str | None = None) -> str:
    norm = norm or b.add(POWER, b.add(DEGREES, "graph"), value=-0.5, out="gcn_norm")
    h = b.add(AGGREGATE, b.add(ROW_SCALE, norm, x))
    h = b.add(ROW_SCALE, norm, b.add(FFN, h, weight=f"w{k}", in_dim=i, out_dim=o))
    return b.add(RELU, h) if relu else h


def gat(b: Builder, x: str, i: int, o: int, k: int, relu: bool, norm: str | None = None) -> str:
    h = b.add(FFN, x, weight=f"w{k}", in_dim=i, out_dim=o)
    left, right = (b.add(ATTEN, h, weight=f"a{s}{k}", in_dim=o, out_dim=1) for s in "lr")
    alpha = b.add(SOFTMAX, b.add(LEAKY_RELU, b.add(EDGE_SUM, left, right), value=0.2))
    h = b.add(AGGREGATE, alpha, h)
    return b.add(RELU, h) if relu else h


def gin(b: Builder, x: str, i: int, o: int, k: int, relu: bool, norm: str | None = None) -> str:
    h = b.add(ADD, b.add(EPS_SCALE, x, value=1.0, weight=f"eps{k}", in_dim=1, out_dim=1), b.add(AGGREGATE, x))
    h = b.add(FFN, h, weight=f"w{k}", in_dim=i, out_dim=o)
    return b.add(RELU, h) if relu else h


def sage(b: Builder, x: str, i: int, o: int, k: int, relu: bool, norm: str | None = None) -> str:
    norm = norm or b.add(POWER, b.add(DEGREES, "graph"), value=-1.0, out="sage_norm")
    mean = b.add(ROW_SCALE, norm, b.add(AGGREGATE, x))
    h = b.add(ADD, b.add(FFN, mean, weight=f"w{k}", in_dim=i, out_dim=o), b.add(FFN, x, weight=f"s{k}", in_dim=i, out_dim=o))
    return b.add(RELU, h) if relu else h


LAYERS = {"gcn": gcn, "gat": gat, "gin": gin, "sage": sage}


def model(kind: str, dims: Sequence[int], last_relu: bool = False, **how) -> ModelSpec:
    """A stack of layers of widths ``dims``; degrees and norms are made once."""
    b, h, norm = Builder(), "features", None
    for k in range(len(dims) - 1):
        h = LAYERS[kind](b, h, dims[k], dims[k + 1], k, last_relu or k < len(dims) - 2, norm)
        norm = next((op.out for op in b.ops if op.kind == POWER), None)
    return ModelSpec(tuple(b.ops), h, **how)
