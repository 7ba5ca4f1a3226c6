"""Named queries of this package and their SQL counterparts."""

from __future__ import annotations

from alertloom.llm.arrow_files import op4_arrow_files
from alertloom.llm.chosen_path import op7_chosen_path
from alertloom.llm.decontaminate import op5_decontamination
from alertloom.llm.divergence import op3_distribution_divergence
from alertloom.llm.hilbert import op9_hilbert_sharding
from alertloom.llm.packing import op6_harmonic_packing
from alertloom.llm.paragraphs import op10_paragraph_banding
from alertloom.llm.periodic import op12_periodic_runs
from alertloom.llm.pitman_yor import op8_pitman_yor
from alertloom.llm.positive_unlabelled import op13_positive_unlabelled
from alertloom.llm.suffix_dedup import op1_suffix_array_dedup
from alertloom.llm.surrogates import op2_surrogates
from alertloom.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_surrogates": op2_surrogates,
    "op3_distribution_divergence": op3_distribution_divergence,
    "op4_arrow_files": op4_arrow_files,
    "op5_decontamination": op5_decontamination,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op7_chosen_path": op7_chosen_path,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_hilbert_sharding": op9_hilbert_sharding,
    "op10_paragraph_banding": op10_paragraph_banding,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_positive_unlabelled": op13_positive_unlabelled,
}

#: Where SQL can't say it (tokenizers, checksums, sampling, similarity at scale), tests compare with brute force.
ORACLES: dict[str, str] = {}
