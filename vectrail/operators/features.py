"""Which columns of an example table a classifier may see: identifiers, outcomes, and what is known before prediction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# The names and name parts by which columns are told apart, and what each ablation leaves out.
IDENTIFIERS = ["run_id", "signature_id", "split_json_path", "output_dir", "log_file", "control_label_used"]
IDENTIFIER_ENDINGS = ("_path", "_file")
OUTCOMES = [
    "cosine_similarity", "pearson_r", "spearman_r", "rmse", "mae", "delta_norm_true", "log1p_delta_norm_true", "risk", "transportable",
    "target_transportable", "target_fidelity", "target_risk", "failure_mode", "transport_threshold",
    "top_deg_overlap_at_20", "top_deg_overlap_at_50", "top_deg_overlap_at_100",
    "deg_direction_consistency_at_20", "deg_direction_consistency_at_50", "deg_direction_consistency_at_100",
    "recall_at_20", "recall_at_50", "recall_at_100", "ndcg_at_20", "ndcg_at_50", "ndcg_at_100", "map_at_20", "map_at_50", "map_at_100",
    "pathway_cosine", "pathway_direction_consistency", "mean_pathway_cosine", "mean_pathway_direction_consistency",
    "perturbation_retrieval_top1", "perturbation_retrieval_top5", "perturbation_retrieval_top10",
]
OUTCOME_PARTS = [
    "cosine", "pearson", "spearman", "rmse", "mae", "risk", "transport", "target_", "failure", "deg_", "recall_at_", "ndcg_at_", "map_at_",
    "pathway_cosine", "retrieval",
]
CATEGORICAL = ["model", "split_family", "dataset_id", "source_dataset", "dataset_scope", "heldout_target", "gene_space_policy", "batch", "timepoint"]
DEPLOYMENT = [
    "confidence", "delta_norm_pred", "log1p_delta_norm_pred", "n_cells", "stress_family_flag", "reference_seen_in_train", "dataset_seen_in_train",
    "batch_seen_in_train", "timepoint_seen_in_train", "perturbation_seen_in_train", "is_combination", "component_count", "component_seen_fraction",
    "unseen_component_count", "perturbation_train_signature_count", "perturbation_train_cell_count", "reference_train_signature_count",
    "reference_train_cell_count", "dataset_train_signature_count", "dataset_train_cell_count", "log1p_perturbation_train_signature_count",
    "log1p_perturbation_train_cell_count", "log1p_reference_train_signature_count", "log1p_reference_train_cell_count",
    "log1p_dataset_train_signature_count", "log1p_dataset_train_cell_count", "train_units", "validation_units", "test_units",
    "train_perturbations", "validation_perturbations", "test_perturbations", "train_reference_keys", "validation_reference_keys",
    "test_reference_keys", "reference_key_overlap_train_test", "declared_holdout_overlap_train_test", "train_test_centroid_l2",
    "train_test_centroid_cosine", "n_test_non_control", "n_test_control", "bio_feature_available", "bio_pathway_support_count",
]
DEPLOYMENT_BEGINNINGS = ("log1p_", "bio_")
ABLATIONS = {
    "full": [],
    "no_context_distance": ["centroid", "reference_", "reference_key", "reference_seen", "train_reference"],
    "no_perturbation_novelty": ["perturbation_", "component", "combination", "unseen_component"],
    "no_uncertainty_features": ["confidence", "delta_norm_pred"],
    "no_pathway_features": ["bio_", "pathway", "string", "reactome"],
}
#: Groups of features by name parts; the first that fits counts.
GROUPS = [
    ("context_distance", ["centroid", "reference"]),
    ("perturbation_novelty", ["perturbation", "component", "combination"]),
    ("prediction_confidence_uncertainty", ["confidence", "delta_norm_pred"]),
    ("support_availability", ["cell_count", "signature_count"]),
]
SUPPORT = ["n_cells", "train_units", "validation_units", "test_units", "n_test_non_control", "n_test_control"]

_NUMBERS = ("double", "float", "tinyint", "smallint", "int", "bigint", "boolean")


@dataclass(frozen=True)
class FeatureSpec:
    numeric: list[str]
    categorical: list[str]

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.categorical


def _holds(name: str, parts: list[str]) -> bool:
    return any(p in name for p in parts)


def role(name: str) -> str:
    """identifier, outcome, deployment or evaluation; an identifier or outcome is one whatever other list it stands on."""
    if name in IDENTIFIERS or name.lower().endswith(IDENTIFIER_ENDINGS):
        return "identifier"
    if is_outcome(name):
        return "outcome"
    known = name in CATEGORICAL or name in DEPLOYMENT or name.startswith(DEPLOYMENT_BEGINNINGS)
    return "deployment" if known else "evaluation"


def is_outcome(name: str) -> bool:
    return name in OUTCOMES or _holds(name.lower(), OUTCOME_PARTS)


def group(name: str) -> str:
    """The kind of knowledge a feature stands for."""
    if name in CATEGORICAL:
        return "model_split_dataset_indicator"
    for label, parts in GROUPS:
        if _holds(name, parts) or (label == "support_availability" and name in SUPPORT):
            return label
    return "optional_biology" if name.startswith("bio_") or "pathway" in name else "other"


def feature_spec(df: DataFrame, mode: str = "deployment") -> FeatureSpec:
    """The columns a classifier gets: those known at deployment, or all that are neither listed outcomes nor identifiers."""
    if mode not in ("deployment", "all"):
        raise ValueError("mode is deployment or all")
    kinds = dict(df.dtypes)
    keep = sorted(c for c in kinds if c not in OUTCOMES and c not in IDENTIFIERS and (mode == "all" or role(c) == "deployment"))
    return FeatureSpec([c for c in keep if c not in CATEGORICAL and kinds[c].startswith((*_NUMBERS, "decimal"))], [c for c in keep if c in CATEGORICAL])


_REASONS = {
    "identifier": "would let runs or signatures be memorised",
    "outcome": "a target, label or outcome of evaluation",
    "deployment": "known at deployment",
    "evaluation": "not on the list of deployment features",
}


def feature_audit(df: DataFrame, mode: str = "deployment") -> DataFrame:
    """One row a column: its type, source and ablation group, its role in flags, whether it is left out, and why."""
    chosen = set(feature_spec(df, mode).columns)
    rows = []
    for c, kind in df.dtypes:
        what = role(c)
        typ = "categorical" if c in CATEGORICAL else "numeric" if kind.startswith((*_NUMBERS, "decimal")) else "non_feature"
        source = {"identifier": "identifier", "outcome": "target_or_evaluation_outcome"}.get(what, group(c))
        rows.append((c, typ, source, group(c), what == "deployment", what == "evaluation", is_outcome(c), what == "identifier", c not in chosen, _REASONS[what]))
    schema = "feature string, type string, source_group string, ablation_group string, deployment_available boolean, evaluation_only boolean, target_or_label boolean, identifier boolean, left_out boolean, reason string"
    return df.sparkSession.createDataFrame(rows, schema)


def ablate(spec: FeatureSpec, ablation: str) -> FeatureSpec:
    """``spec`` without the features of one kind; KeyError for an unknown ablation."""
    drop = ABLATIONS[ablation]
    return FeatureSpec([c for c in spec.numeric if not _holds(c, drop)], [c for c in spec.categorical if not _holds(c, drop)])


#: Feature subsets of the reliability baselines, and the estimator each goes with.
_COUNTS = [f"{a}_train_{b}_count" for a in ("perturbation", "reference", "dataset") for b in ("signature", "cell")]
_NOVEL = ["perturbation_seen_in_train", "is_combination", "component_count", "component_seen_fraction", "unseen_component_count", "reference_seen_in_train", "dataset_seen_in_train"]
BASELINES = {
    "split_family_only": ([], ["split_family"], "logistic_regression"),
    "support_only": (["n_cells", *_COUNTS], [], "logistic_regression"),
    "novelty_only": (_NOVEL, [], "logistic_regression"),
    "support_plus_novelty": (["n_cells", *_COUNTS, *_NOVEL], [], "logistic_regression"),
    "calibrated_logistic_deployment": (
        ["confidence", "delta_norm_pred", "n_cells", *_COUNTS[::2], "perturbation_seen_in_train", "component_seen_fraction", "unseen_component_count", "train_test_centroid_l2"],
        ["model", "split_family", "dataset_id", "dataset_scope"], "logistic_regression",
    ),
    "full_random_forest": (
        ["confidence", "delta_norm_pred", "n_cells", "stress_family_flag", *_NOVEL, *_COUNTS, "train_units", "test_units", "train_perturbations", "test_perturbations",
         "reference_key_overlap_train_test", "declared_holdout_overlap_train_test", "train_test_centroid_l2", "train_test_centroid_cosine"],
        ["model", "split_family", "dataset_id", "dataset_scope", "heldout_target", "gene_space_policy"], "random_forest",
    ),
}


def baseline_specs(df: DataFrame) -> dict[str, tuple[FeatureSpec, str]]:
    """The subsets with the columns ``df`` has; those of which it has none are left out."""
    there = set(df.columns)
    specs = {name: (FeatureSpec([c for c in n if c in there], [c for c in k if c in there]), e) for name, (n, k, e) in BASELINES.items()}
    return {name: s for name, s in specs.items() if s[0].columns}
