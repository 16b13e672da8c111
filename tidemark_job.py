"""Entry file for spark-submit."""

from tidemark.__main__ import main

if __name__ == "__main__":
    main()
