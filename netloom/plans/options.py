"""Named options of a partitioning run."""

from __future__ import annotations

from dataclasses import dataclass, field


#: Option names, the default first, then the other choices (none: a number).
CHOICES: dict[str, tuple] = {
    "LoadbalanceStrategy": ("constant", "increase", "decrease"),
    "LoadbalanceAdjust": ("yes", "no"),
    "SplitStrategy": ("mediumgrain", "alternate", "localbest", "hybrid", "localratio", "onedimrow", "onedimcol", "finegrain", "symfinegrain"),
    "Alternate_FirstDirection": ("ratio", "row", "col"),
    "SplitMethod": ("KLFM", "simple"),
    "Partitioner": ("builtin", "external"),
    "Metric": ("lambda1", "cutnet", "lambdalambda1"),
    "Discard_Free_Nets": ("yes", "no"),
    "ZeroVolumeSearch": ("yes", "no"),
    "ImproveFreeNonzeros": ("yes", "no"),
    "CheckUpperBound": ("yes", "no"),
    "SquareMatrix_DistributeVectorsEqual": ("no", "yes"),
    "SquareMatrix_DistributeVectorsEqual_AddDummies": ("yes", "no"),
    "SymmetricMatrix_UseSingleEntry": ("no", "yes"),
    "SymmetricMatrix_SingleEntryType": ("lower", "random"),
    "Coarsening_NrVertices": (200,),
    "Coarsening_MaxCoarsenings": (128,),
    "Coarsening_NrMatchArbitrary": (0,),
    "Coarsening_MaxNrVtxInMatch": (2,),
    "Coarsening_StopRatio": (0.05,),
    "Coarsening_VtxMaxFractionOfWeight": (0.2,),
    "Coarsening_MatchingStrategy": ("ata", "random", "inproduct"),
    "Coarsening_MatchingATAMatcher": ("pga", "greedy"),
    "Coarsening_MatchingATAFinder": ("inproduct", "stairway"),
    "Coarsening_FineSwitchLevel": (2,),
    "Coarsening_InprodMatchingOrder": ("decrwgt", "incrwgt", "decrdeg", "incrdeg", "natural", "random"),
    "Coarsening_NetScaling": ("linear", "no"),
    "Coarsening_InprodScaling": ("min", "no", "cos", "max", "jaccard"),
    "Coarsening_MatchIdenticalFirst": ("yes", "no"),
    "KLFM_InitPart_NrRestarts": (8,),
    "KLFM_InitPart_MaxNrLoops": (25,),
    "KLFM_InitPart_MaxNrNoGainMoves": (200,),
    "KLFM_Refine_MaxNrLoops": (25,),
    "KLFM_Refine_MaxNrNoGainMoves": (200,),
    "VectorPartition_Step3": ("random", "increase", "decrease"),
    "VectorPartition_MaxNrLoops": (10,),
    "VectorPartition_MaxNrGreedyImproves": (10,),
    "OutputFormat": ("original", "EMM"),
    "OutputMode": ("original", "onefile", "DIMACS"),
    "Seed": (99,),
    "Permute": ("none", "reverseBBD", "SBD", "BBD"),
    "EnforceSymmetricPermutation": ("no", "yes"),
    "Iterative_Refinement": ("aftermg", "never", "always"),
}

#: Options that have no effect here: any value but the default raises when a partitioning run begins.
UNSUPPORTED = (
    "LoadbalanceAdjust", "Metric", "Discard_Free_Nets", "SquareMatrix_DistributeVectorsEqual_AddDummies", "SymmetricMatrix_UseSingleEntry",
    "SymmetricMatrix_SingleEntryType", "Coarsening_NrMatchArbitrary", "Coarsening_MaxNrVtxInMatch", "Coarsening_VtxMaxFractionOfWeight", "Coarsening_MatchingStrategy",
    "Coarsening_MatchingATAMatcher", "Coarsening_MatchingATAFinder", "Coarsening_FineSwitchLevel", "Coarsening_InprodMatchingOrder", "Coarsening_NetScaling", "Coarsening_MatchIdenticalFirst",
    "KLFM_InitPart_MaxNrLoops", "KLFM_InitPart_MaxNrNoGainMoves", "EnforceSymmetricPermutation",
)


@dataclass(frozen=True)
class Options:
    """Values by name; unknown names, values and combinations raise."""

    values: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, value in self.values.items():
            if name not in CHOICES:
                raise ValueError(f"unknown option {name}")
            default = CHOICES[name][0]
            if isinstance(default, str):
                if value not in CHOICES[name]:
                    raise ValueError(f"{name}: {value} is none of {', '.join(CHOICES[name])}")
            else:
                try:
                    number = type(default)(value)
                except (TypeError, ValueError):
                    raise ValueError(f"{name}: {value} is not a number") from None
                if number < 0:
                    raise ValueError(f"{name}: {value} is negative")
                self.values[name] = number
        if self["Metric"] == "cutnet" and self["Discard_Free_Nets"] == "no":
            raise ValueError("the cut-net metric requires that free nets are discarded")
        if self["Partitioner"] != "builtin":
            raise ValueError("external partitioners are not part of this engine")
        if self["Metric"] == "lambdalambda1":
            raise ValueError("the lambda (lambda - 1) metric needs an external partitioner")
        if self["Coarsening_MatchingATAMatcher"] == "greedy" and self["Coarsening_MaxNrVtxInMatch"] != 2:
            raise ValueError("greedy matching makes groups of two only")

    def require_supported(self) -> None:
        """Raises if an option that has no effect here was set to something else than its default."""
        if wrong := [name for name in UNSUPPORTED if self[name] != CHOICES[name][0]]:
            raise NotImplementedError(f"not supported: {', '.join(f'{name} {self[name]}' for name in wrong)}")

    def __getitem__(self, name: str):
        return self.values.get(name, CHOICES[name][0])

    @classmethod
    def parse(cls, text: str) -> Options:
        """From ``Key Value`` lines; ``#`` begins a comment."""
        pairs = [line.split("#")[0].split() for line in text.splitlines()]
        for p in pairs:
            if len(p) not in (0, 2):
                raise ValueError(f"not a key and a value: {' '.join(p)}")
        return cls({p[0]: p[1] for p in pairs if p})

    @classmethod
    def arguments(cls, args: list[str]) -> Options:
        """From ``-Key=Value`` arguments."""
        return cls(dict(a.lstrip("-").split("=", 1) for a in args))

    def to_text(self) -> str:
        return "".join(f"{k} {self[k]}\n" for k in CHOICES)

    def to_latex(self) -> str:
        rows = "".join(f"{k.replace('_', chr(92) + '_')} & {self[k]} {chr(92) * 2}\n" for k in CHOICES)
        return "\\begin{tabular}{ll}\n" + rows + "\\end{tabular}\n"


__all__ = ["CHOICES", "Options"]
