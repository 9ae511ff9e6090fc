"""Parameters of the registered queries (shared by the Spark plans and their SQL twins)."""

SEED = 42  # the reference's seed everywhere
VOCAB_SIZE = 8000  # learned word pieces of the word model
SEQ_LEN = 64  # packed block length
SHARDS = 4  # loader workers
BATCH_SIZE = 8  # packed samples per batch
EVAL_BATCH = 4  # collated evaluation rows per batch
ACCUMULATE = 4  # batches per optimizer update
EVAL_MAX_LEN = 1024  # truncation of evaluation texts (incl. <s> and </s>)
MAX_EVAL_BATCHES = 30  # evaluation stops after this many batches
CHECKPOINT_INTERVAL = 128  # steps between evaluations
CROP = 16  # context crop of prompts
ALPHA = 0.1  # add-alpha smoothing of the bigram model
TEMPERATURE = 0.6
TOP_K = 50
TOP_P = 0.95
PENALTY = 1.3
SHUFFLE_BUFFER = 100
MAX_SAMPLES = 100
LOADER_SAMPLES = 60  # documents per worker in the limited loader
MAX_DOCUMENTS = 300
BYTE_CAP_DOCUMENTS = 1_000_000  # row cap that goes with the byte cap
MAX_BYTES = 1_000_000
BYTE_CHECK_EVERY = 100
COVERAGE = 0.9995
TERMINATORS = ("。", ".")  # sentence ends; the second one occurs in the test texts
NORMALISE_RULES = [("ß", "ss"), ("é", "e"), ("%%%", "%"), ("«", '"')]
SCORE_TOP_K = 5
MIX_PRESET = "balanced"
MIX_GENRE = "wiki"
SINGLE_GENRE = "literature"
BPE_MERGES = 3
SEED_PIECES = 1000
SEED_MAX_LEN = 16
UNIGRAM_VOCAB = 12_000
UNIGRAM_SEEDS = 1_000_000
BPE_FULL_MERGES = 24  # of the run that SQL unrolls
BPE_VOCAB_MERGES = 3000  # of the vocabulary that encodes
