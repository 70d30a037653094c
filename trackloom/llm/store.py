"""Tables kept between jobs, in the folder that the whole cluster shares."""

from trackloom.sources.store import new_path, shared_folder, stored, writing

__all__ = ["new_path", "shared_folder", "stored", "writing"]
