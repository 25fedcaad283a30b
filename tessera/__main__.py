"""Says which package this is."""

import tessera

if __name__ == "__main__":
    print(f"tessera {tessera.__version__}")
