"""Schemas and fixed values of the read model."""

READ = "read_idx bigint, id string, comment string, sequence string, quality string"
MANIFEST = "total_reads bigint, num_blocks bigint, original_filename string, created timestamp, is_paired boolean, has_reorder_map boolean, preserve_order boolean, streaming_mode boolean, quality_mode string, id_mode string, pe_layout string, read_length_class string, flags bigint, global_checksum string"
BLOCK = "block_id int, archive_id_start bigint, read_count int, uniform_read_length int, codec_ids smallint, codec_seq smallint, codec_qual smallint, codec_aux smallint, checksum bigint, qual_order int, ids_data binary, seq_data binary, qual_data binary, aux_data binary"

# Fixed values of the model
BLOCK_READS = {"short": 100_000, "medium": 50_000, "long": 10_000}
SHORT_MAX_LENGTH, MEDIUM_MEDIAN, LONG_MIN_LENGTH = 511, 1024, 10_240
LENGTH_SAMPLE = 4096
KMER, MINIMIZER_WINDOW, MAX_CANDIDATES = 15, 10, 64
MAX_SHIFT, HAMMING_LIMIT, CONSENSUS_READS = 32, 16, 4096
ILLUMINA_BOUNDS, ILLUMINA_VALUES = (2, 10, 20, 25, 30, 35, 40, 255), (2, 6, 15, 22, 27, 33, 37, 40)
CODEBOOK = (7, 15, 20, 25, 30, 35, 40, 41)
ZSTD_LEVELS = {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 9, 8: 9, 9: 15}
QUALITY_MODES, ID_MODES = ("none", "illumina8", "qvz", "discard"), ("exact", "tokenize", "discard")
PE_LAYOUTS, LENGTH_CLASSES = ("interleaved", "consecutive"), ("short", "medium", "long")
NOISE = {"A": "CGTN", "C": "AGTN", "G": "TACN", "T": "GCAN", "N": "AGCT"}
DEFAULT_LENGTH = {"streaming": 1024, "pipeline": 150}
