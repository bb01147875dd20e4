"""groundline: source-grounded extraction over DataFrames."""

from .config import Config, config, configure, reset_configuration
from .errors import AlignmentError, FormatParsingError, GroundlineError, InvalidModelConfigError, IOFailure, PromptValidationError, ProviderConfigError
from .functions.intervals import Interval
from .operators.alignment import Aligner, annotate
from .operators.chunks import chunk_spans, chunked, sentence_rows, sentences
from .operators.models import ConstantModel, ModelConfig, Provider, RegexModel, ReplayModel, create_model, router
from .operators.parsing import parse, parsed
from .operators.prompts import Example
from .operators.tokens import NON_SPACE_TOKENS, UNICODE_TOKENS, Tokenizer, token_rows, tokenize, with_offsets
from .plans.pipeline import Options, extract, extract_from_outputs, extract_text, extraction_rows, model_outputs
from .sources.documents import from_table, from_text, from_values
from .sources.html import visualize

__version__ = "0.1.0"
