"""shotweave: few-shot corpus sampling, augmentation and evaluation as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
lazy DataFrame. Nothing is collected to the driver except bounded metadata
(label/domain lists of at most ``MAX_CLASSES`` entries) that a pivot or a
literal array needs.
"""

from shotweave.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
