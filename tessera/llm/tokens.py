"""The encoder of tessera.functions.bytewords, for the corpus operators."""

from tessera.functions.bytewords import Encoder, default_path, encoder

__all__ = ["Encoder", "default_path", "encoder"]
