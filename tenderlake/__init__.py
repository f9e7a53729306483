"""tenderlake — opportunity intelligence as Spark DataFrame functions.

Every public function takes DataFrames (plus plain Python policy values) and
returns DataFrames.  Nothing is collected to the driver inside the library;
callers decide when to act.
"""

from tenderlake.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
