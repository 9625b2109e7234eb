"""Errors that users of a lake meet."""


class LakeError(ValueError):
    """A request that the lake can't carry out."""


class ConflictError(RuntimeError):
    """Another commit got in the way of this one."""
